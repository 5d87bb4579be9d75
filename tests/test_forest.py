import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from stayscope.operators import forest as f
from stayscope.operators import ml


def rows(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 25, n), rng.normal(size=n).round(1)], 1).astype(float)
    return x, 10 * (x[:, 0] > 4) + x[:, 1] / 5 + 3 * x[:, 2] + rng.normal(size=n)


def table(spark, x, y):
    data = [(v.tolist(), None if t is None else float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(data, "features array<double>, price double").repartition(3).withColumn("features", array_to_vector("features"))


def model(**kw):
    return ml.forest_model(**{"trees": 20, "depth": 6, **kw})


def rmse(scored):
    return scored.agg(F.sqrt(F.avg((F.col("price") - F.col("prediction")) ** 2))).first()[0]


def plain(bins, y, weight, depth, least):
    """Predictions of the same tree by exhaustive search, and the drops of squared errors per feature."""
    out, gains = np.zeros(len(y)), np.zeros(bins.shape[1])

    def error(m):
        mean = np.average(y[m], weights=weight[m])
        return (weight[m] * (y[m] - mean) ** 2).sum()

    def node(mask, level):
        drawn = mask & (weight > 0)
        best = (1e-6, None, None)
        for j in range(bins.shape[1]) if level < depth else ():
            for v in np.unique(bins[drawn, j])[:-1]:
                left = bins[:, j] <= v
                a, b = drawn & left, drawn & ~left
                if min(weight[a].sum(), weight[b].sum()) >= least:
                    gain = error(drawn) - error(a) - error(b)
                    if gain > best[0] + 1e-6:
                        best = gain, left, j
        if best[1] is None:
            out[mask] = np.average(y[drawn], weights=weight[drawn])
        else:
            gains[best[2]] += best[0]
            node(mask & best[1], level + 1)
            node(mask & ~best[1], level + 1)

    node(np.ones(len(y), bool), 0)
    return out, gains


@pytest.mark.parametrize("nodes, block", [(256, 131_072), (3, 50)])
def test_tree_equals_exhaustive_search(monkeypatch, nodes, block):
    monkeypatch.setattr(f, "NODES", nodes)
    monkeypatch.setattr(f, "BLOCK_ROWS", block)
    x, y = rows()
    bins = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], 1).astype(np.uint8)
    tree = f.grown_tree(bins, y, int(bins.max()) + 1, f.Draws(5, 3, 1.0, 5, 0.0, 7), 4)
    weight = np.random.default_rng([7, 4]).poisson(1.0, len(y))
    want, gains = plain(bins, y, weight, 5, 5)
    assert f.predicted([tree.steps()], bins, 5) == pytest.approx(want)
    assert tree.gains == pytest.approx(gains)


def test_nodes_draw_features():
    x, y = rows(2_000)
    bins = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], 1).astype(np.uint8)
    first = [f.grown_tree(bins, y, 70, f.Draws(1, 1, 1.0, 5, 0.0, 7), k).feature[0] for k in range(30)]
    assert set(first) == {0, 1, 2}
    assert {f.grown_tree(bins, y, 70, f.Draws(1, 3, 1.0, 5, 0.0, 7), k).feature[0] for k in range(30)} == {0}
    counts = [f._drawn_features(s, 200, 16) for s in ("0.8", "auto", "all", "sqrt", "log2", "5", "1.0")]
    assert counts == [13, 6, 16, 4, 4, 5, 16]


def test_jobs_do_not_grow_with_depth(spark):
    """Spark's forest takes jobs for each level, and sends the statistics of all nodes through a shuffle."""
    df, jobs = table(spark, *rows(1_500)).cache(), []
    for depth in (2, 12):
        spark.sparkContext.setJobGroup(f"forest-{depth}", "trees")
        try:
            model(depth=depth).fit(df)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
    assert jobs[1] <= jobs[0]


def test_is_as_good_as_spark_and_survives_saving(spark, tmp_path):
    train, test = table(spark, *rows(3_000)), table(spark, *rows(2_000, 4))
    fitted = model(trees=40).fit(train)
    own = RandomForestRegressor(
        labelCol="price", numTrees=40, maxDepth=6, minInstancesPerNode=5, featureSubsetStrategy="0.8", seed=1
    ).fit(train)
    scored = fitted.transform(test)
    assert rmse(scored) == pytest.approx(rmse(own.transform(test)), rel=0.03) and rmse(scored) < 1.6
    shares = fitted.featureImportances.toArray()
    assert shares == pytest.approx(own.featureImportances.toArray(), abs=0.03) and shares.sum() == pytest.approx(1.0)
    path = str(tmp_path / "m")
    PipelineModel([fitted]).write().save(path)
    again = PipelineModel.load(path)
    assert again.transform(test).exceptAll(scored).count() == 0
    assert again.stages[0].featureImportances == fitted.featureImportances


def test_repeated_fits_are_equal(spark):
    df = table(spark, *rows()).coalesce(1).cache()
    a, b = (model(trees=3).fit(df).transform(df) for _ in range(2))
    assert a.count() == 600 and a.exceptAll(b).count() == 0


def test_bounds_lie_midway(spark):
    x = np.array([[0.0], [2.0], [7.0]] * 40)
    fitted = model(trees=5).fit(table(spark, x, x[:, 0] ** 2))
    assert fitted._read()[0] == [[1.0, 4.5]]
    new = fitted.transform(table(spark, np.array([[0.9], [1.0], [1.1], [4.6], [-5.0], [99.0]]), [0.0] * 6))
    assert {r["features"][0]: round(r["prediction"], 6) for r in new.collect()} == {0.9: 0, 1.0: 0, 1.1: 4, 4.6: 49, -5.0: 0, 99.0: 49}


def test_odd_tables(spark):
    x, y = rows(60)
    constant = model(trees=3).fit(table(spark, np.ones((60, 2)), y))
    assert constant.trees.count() == 3 and constant._read()[0] == [[], []]
    assert constant.featureImportances.toArray().tolist() == [0.0, 0.0]
    assert len({r["prediction"] for r in constant.transform(table(spark, x[:, :2], y)).collect()}) == 1
    for bad in ([None, *y[1:]], [float("nan"), *y[1:]]):
        with pytest.raises(Exception, match="null or NaN"):
            model().fit(table(spark, x, bad))
    with pytest.raises(Exception, match="NaN or infinite"):
        model().fit(table(spark, np.where(x == x[0], np.inf, x), y))
    with pytest.raises(Exception, match="size of input RDD > 0"):
        model().fit(table(spark, x, y).limit(0))


def test_more_rows_than_a_task_holds_go_to_spark(spark, monkeypatch):
    df = table(spark, *rows())
    assert isinstance(model(trees=2).fit(df), f.GrownForest)
    monkeypatch.setattr(f, "TASK_CELLS", 600 * 3 - 1)
    assert model(trees=2).fit(df).getNumTrees == 2


def test_trees_do_not_pass_the_driver(spark, monkeypatch):
    """Tasks read the trees from their files; only from a store that they cannot open do the trees come by the driver."""
    df = table(spark, *rows())
    fitted, sent = model(trees=5).fit(df), []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or broadcast(value))
    scored = fitted.transform(df).cache()
    assert scored.count() == 600 and sent == []

    def unknown(*_):
        raise ValueError("name one of the stores")

    monkeypatch.setattr(f, "qualified", unknown)
    assert fitted.transform(df).exceptAll(scored).count() == 0 and len(sent[0]) == 5
