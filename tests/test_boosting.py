import json

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stayscope.operators import boosting as b


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 40, n), rng.normal(size=n).round(1)], 1).astype(float)
    y = 10 * (x[:, 0] > 4) + x[:, 1] / 5 + 3 * x[:, 2] + rng.normal(size=n)
    return x, y


def table(spark, x, y):
    data = [(v.tolist(), None if t is None else float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(data, "features array<double>, price double").repartition(3)


def score(g, n, p):
    return max(abs(g) - p.l1, 0) ** 2 / (n + p.l2)


def value(g, n, p):
    return -np.sign(g) * max(abs(g) - p.l1, 0) / (n + p.l2)


def plain(x, y, rounds, step, depth, p):
    """The same trees by exhaustive search over sorted values."""
    f = np.full(len(y), y.mean())

    def node(mask, level, g):
        sums = g[mask].sum(), mask.sum()
        best = (1e-9, None)
        for j in range(x.shape[1]) if level < depth else ():
            for v in np.unique(x[mask, j])[:-1]:
                left = mask & (x[:, j] <= v)
                right = mask & ~left
                if min(left.sum(), right.sum()) < p.min_rows:
                    continue
                gain = (score(g[left].sum(), left.sum(), p) + score(g[right].sum(), right.sum(), p) - score(*sums, p)) / 2 - p.leaf
                if gain > best[0] + 1e-9:
                    best = gain, (left, right)
        if best[1] is None:
            out[mask] = step * value(*sums, p)
        else:
            for side in best[1]:
                node(side, level + 1, g)

    for _ in range(rounds):
        out = np.zeros(len(y))
        node(np.ones(len(y), bool), 0, f - y)
        f = f + out
    return f


@pytest.mark.parametrize("p", [b.Penalties(l2=0.0), b.Penalties(l1=20.0, l2=5.0, leaf=30.0, min_rows=12)])
def test_equals_exhaustive_search(spark, p):
    x, y = rows()
    df = table(spark, x, y).withColumn("key", F.monotonically_increasing_id())
    model = b.PenalisedBoosting(rounds=3, step=0.4, depth=3, penalties=p).fit(df)
    got = {tuple(r["features"]): r["prediction"] for r in model.transform(df).collect()}
    expected = plain(x, y, 3, 0.4, 3, p)
    assert max(abs(got[tuple(v.tolist())] - e) for v, e in zip(x, expected)) < 1e-6


def test_leaf_values_are_the_closed_form(spark):
    x, y = rows()
    p = b.Penalties(l1=15.0, l2=4.0, leaf=0.0)
    model = b.PenalisedBoosting(rounds=1, step=1.0, depth=1, penalties=p).fit(table(spark, x, y))
    tree = model.trees[0]
    left = x[:, tree.feature[0]] <= tree.threshold[0]
    g = y.mean() - y
    assert tree.value[1:] == pytest.approx([value(g[left].sum(), left.sum(), p), value(g[~left].sum(), (~left).sum(), p)])


def test_penalties_shrink(spark):
    df = table(spark, *rows())
    fit = lambda **kw: b.PenalisedBoosting(rounds=1, step=1.0, depth=2, penalties=b.Penalties(**kw)).fit(df).trees[0]
    assert max(map(abs, fit(l2=1000.0).value)) < max(map(abs, fit(l2=0.0).value))
    assert fit(leaf=1e9).feature == [-1] and fit(l1=1e9).value == [0.0]


def test_draws_state_and_learning(spark, tmp_path):
    x, y = rows(1500)
    df = table(spark, x, y)
    boost = b.PenalisedBoosting(rounds=40, step=0.2, depth=3, row_share=0.75, column_share=0.67, seed=1)
    model = boost.fit(df)
    error = lambda m: m.transform(df).agg(F.sqrt(F.avg((F.col("price") - F.col("prediction")) ** 2))).first()[0]
    assert error(model) < 1.5 < np.std(y)
    used = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and set().union(*used) == {0, 1, 2}
    assert sum(model.featureImportances.toArray()) == pytest.approx(1.0)
    # A model written and read again predicts the same.
    path = str(tmp_path / "m")
    PipelineModel([model]).write().save(path)
    again = PipelineModel.load(path)
    assert error(again) == error(model)


def test_odd_tables(spark):
    x, y = rows(50)
    df = table(spark, x, [None if i % 5 == 0 else t for i, t in enumerate(y)])
    model = b.PenalisedBoosting(rounds=1, depth=1).fit(df)
    assert model._read()[0] == pytest.approx(np.mean([t for i, t in enumerate(y) if i % 5]))
    empty = b.PenalisedBoosting(rounds=2, depth=2).fit(df.limit(0))
    assert [r["prediction"] for r in empty.transform(df.limit(0)).collect()] == [] and empty.trees == []
    same = b.PenalisedBoosting(rounds=2, depth=3).fit(table(spark, np.ones((20, 3)), y[:20]))
    assert all(t.feature == [-1] for t in same.trees)


def test_many_values_are_binned(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 1))
    edges = b.bin_edges(table(spark, x, x[:, 0]).select(F.col("features").alias("x")), 1)
    assert 200 < len(edges[0]) <= b.BINS and edges[0][-1] == x.max()


def test_folds_grow_together(spark):
    """All folds from the same passes equal a fit for each fold without it."""
    x, y = rows(900)
    df = table(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(4)).cast("int"))
    boost = b.PenalisedBoosting(rounds=3, step=0.5, depth=2, penalties=b.Penalties(l1=1.0))
    got = dict(boost.fold_errors(df, "fold", 5))
    assert got.pop(4) is None
    for k, error in got.items():
        part = df.where(F.col("fold") == k)
        alone = boost.fit(df.where(F.col("fold") != k)).transform(part)
        assert error == pytest.approx(alone.agg(F.sqrt(F.avg((F.col("price") - F.col("prediction")) ** 2))).first()[0])


def test_tasks_share_their_sums(spark, monkeypatch):
    """Several tasks that exchange sums, and a task alone, grow the same trees."""
    x, y = rows()
    p = b.Penalties(l1=5.0, l2=2.0, min_rows=5)
    df = table(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(3)).cast("int"))
    boost = b.PenalisedBoosting(rounds=3, step=0.4, depth=3, penalties=p, row_share=0.8, column_share=0.67)
    alone, errors = boost.fit(df).trees, boost.fold_errors(df, "fold", 3)
    monkeypatch.setattr(b, "TASK_ROWS", 150)
    for one, many in zip(alone, boost.fit(df).trees, strict=True):
        assert (one.feature, one.bin, one.left) == (many.feature, many.bin, many.left)
        assert one.value == pytest.approx(many.value)
    assert [e for _, e in boost.fold_errors(df, "fold", 3)] == pytest.approx([e for _, e in errors])


def test_jobs_do_not_grow_with_rounds(spark):
    df = table(spark, *rows(200))
    spark.sparkContext.setJobGroup("boosting-jobs", "one stage for all rounds")
    try:
        model = b.PenalisedBoosting(rounds=60, step=0.1, depth=4).fit(df)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 60
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting-jobs")) < 20


def test_folds_of_few_rows_take_a_task_each(spark, monkeypatch):
    """Models that fit a task need no exchanges, however many grow."""
    x, y = rows(400)
    df = table(spark, x, y).withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(4)).cast("int"))
    asked, task = [], b.Growth._task
    monkeypatch.setattr(b.Growth, "_task", lambda self, parts, edges, tasks: asked.append((len(parts), tasks)) or task(self, parts, edges, tasks))
    monkeypatch.setattr(b, "TASK_ROWS", 500)
    errors = b.PenalisedBoosting(rounds=2, step=0.5, depth=2).fold_errors(df, "fold", 4)
    assert asked == [(1, 1)] * 4 and None not in dict(errors).values()


@pytest.mark.parametrize("block", [7, 1_000])
def test_sums_hold_every_drawn_row_once(tmp_path, monkeypatch, block):
    monkeypatch.setattr(b, "BLOCK_ROWS", block)
    x, y = rows(50)
    columns = {"row": range(50), "y": y, "fold": [k % 3 for k in range(50)], "x": x.tolist()}
    held = b._Rows(iter([b.pa.RecordBatch.from_pydict(columns)]), [sorted(set(v)) for v in x.T.tolist()], [2.0], str(tmp_path))
    part = b._Part(1, tree=b.Tree(), active=[0])
    g, n = held.sums([part], np.array([0, 2]), 5, 0.7)
    keep = b._drawn(np.arange(50), 5, 0.7) & (np.arange(50) % 3 != 1)
    for place, column in enumerate((0, 2)):
        for at, v in enumerate(sorted(set(x[:, column]))):
            same = keep & (x[:, column] == v)
            assert n.reshape(2, b.BINS)[place, at] == same.sum()
            assert g.reshape(2, b.BINS)[place, at] == pytest.approx((2.0 - y[same]).sum())


def test_columns_of_few_bins_are_summed_together(tmp_path, monkeypatch):
    monkeypatch.setattr(b, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, k, 300) for k in (3, 200, 2, 40, 17, 9)], 1).astype(float)
    edges = [sorted(set(v)) for v in x.T.tolist()]
    columns = {"row": range(300), "y": rng.normal(size=300), "fold": [0] * 300, "x": x.tolist()}
    held = b._Rows(iter([b.pa.RecordBatch.from_pydict(columns)]), edges, [0.0], str(tmp_path))
    assert [group for group, _, _ in held.joint] == [[2, 0, 5, 4]]
    part = b._Part(None, tree=b.Tree(), active=[0])
    part.tree.split(0, 1, 90, 90.0, 1.0, (0.0, 0.0))
    part.active = [1, 2]
    for drawn in ([0, 1, 3], [0, 2, 3, 4, 5], [5]):
        held.nodes[0][:] = 0
        g, n = held.sums([part], np.array(drawn), 5, 0.7)
        keep = b._drawn(np.arange(300), 5, 0.7)
        for node, there in enumerate((x[:, 1] <= edges[1][90], x[:, 1] > edges[1][90])):
            for place, c in enumerate(drawn):
                own, bins = keep & there, np.searchsorted(edges[c], x[:, c])
                want = [np.bincount(bins[own], w, b.BINS) for w in (-np.array(columns["y"])[own], np.ones(own.sum()))]
                assert n.reshape(2, -1, b.BINS)[node, place] == pytest.approx(want[1])
                assert g.reshape(2, -1, b.BINS)[node, place] == pytest.approx(want[0])


def test_predictions_follow_the_trees():
    rng = np.random.default_rng(2)
    deep, leaf = b.Tree(), b.Tree(value=[0.5])
    left = deep.split(0, 1, 0, 0.25, 1.0, (1.0, 2.0))
    deep.split(left + 1, 0, 0, -0.5, 1.0, (3.0, 4.0))
    x = np.vstack([rng.normal(size=(50, 2)), [[-0.5, 0.25], [-0.5, 0.3], [np.nan, np.nan], [np.inf, np.inf]]])
    right, high = x[:, 1] > 0.25, x[:, 0] > -0.5
    assert b.added([deep, leaf], x) == pytest.approx(np.where(right, np.where(high, 4.0, 3.0), 1.0) + 0.5)


def test_halved_sums_grow_the_same_trees(tmp_path, monkeypatch):
    """A table of many blocks, whose leaves are half summed and columns joined, has the trees of one block."""
    x, y = rows(2_000)
    edges = [sorted(set(v)) for v in x.T.tolist()]
    columns = {"row": range(len(y)), "y": y, "fold": [k % 3 for k in range(len(y))], "x": x.tolist()}
    monkeypatch.setattr(b.TaskContext, "get", staticmethod(lambda: type("First", (), {"partitionId": lambda self: 0})()))

    def grown(block):
        monkeypatch.setattr(b, "BLOCK_ROWS", block)
        growth = b.Growth(4, 0.4, 4, b.Penalties(l1=2.0, min_rows=5), 0.8, 0.67, 3)
        parts = [b._Part(None, base=1.0), b._Part(1, base=2.0)]
        (out,) = growth._task(parts, edges, 1)(iter([b.pa.RecordBatch.from_pydict(columns)]))
        return json.loads(out["trees"][0].as_py()), out["sse"].to_pylist(), out["n"].to_pylist()

    (one, sse, n), (many, sse_of_many, n_of_many) = grown(5_000), grown(300)
    assert [(t["feature"], t["bin"]) for t in one] == [(t["feature"], t["bin"]) for t in many]
    assert sse_of_many == pytest.approx(sse) and n_of_many == n and n[1] == 667
