import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stayscope.operators import distribution as d
from stayscope.operators.lookup import attach


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key and one value."""
    rng = np.random.default_rng(7)
    n = 3_000
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "k": np.where(np.arange(n) % 3 == 0, "hot", rng.integers(0, 40, n).astype(str)),
            "v": np.where(np.arange(n) % 3 == 0, 100.0, rng.integers(1, 500, n).astype(float)),
            "w": rng.normal(size=n) * 1e6,
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_quantiles_match_pandas(skewed):
    pdf, df = skewed
    got = d.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}).toPandas().set_index("k")
    expected = pdf.groupby("k")["v"].quantile([0.25, 0.5, 0.99]).unstack()
    for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.99)):
        assert got[name].sort_index().tolist() == pytest.approx(expected[p].sort_index().tolist())


@pytest.mark.parametrize("limit, k", [(1_000_000, 2_000), (100, 8), (100, 200), (5, 64)])
def test_wide_quantiles_are_exact_whatever_the_sketch(skewed, limit, k):
    pdf, df = skewed
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "t": 0.77, "hi": 1.0}
    got, facts = d.wide_quantiles(df, ["id", "v", "w"], probs, limit, k)
    rows = {(r["column"], r["q"]): r["value"] for r in got.collect()}
    assert [facts[f"n_{c}"] for c in ("id", "v", "w")] == [len(pdf)] * 3
    for c in ("id", "v", "w"):
        for name, p in probs.items():
            assert rows[c, name] == pytest.approx(pdf[c].quantile(p))


def test_narrowed_slices_are_small(skewed):
    pdf, df = skewed
    slices = [d._Slice(c, "m", 0.5 * (len(pdf) - 1), len(pdf)) for c in ("id", "w")]
    d._narrow(df, slices, 100, 200)
    for s in slices:
        column = pdf[s.column]
        if s.found is not None:
            assert s.found == pytest.approx(column.quantile(0.5))
            continue
        inside = column[(column > s.low) & (column < s.high)]
        assert s.size == len(inside) <= 100
        assert s.skipped == (column <= s.low).sum()


def test_wide_quantiles_of_nulls_only(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "a double, b double")
    got, _ = d.wide_quantiles(df, ["a", "b"], {"m": 0.5})
    assert [tuple(r) for r in got.collect()] == [("b", "m", 2.0)]
    assert d.wide_quantiles(df, ["a"], {"m": 0.5})[0].count() == 0


def test_percent_rank_equals_window(skewed):
    _, df = skewed
    window = F.percent_rank().over(Window.partitionBy("k").orderBy("v"))
    both = d.with_percent_rank(df, ["k"], "v").withColumn("expected", window)
    assert both.where(F.abs(F.col("percent_rank") - F.col("expected")) > 1e-12).count() == 0
    assert both.count() == df.count()


def test_percent_rank_small(spark):
    df = spark.createDataFrame([("a", 10), ("a", 10), ("a", 20), ("a", 30), ("b", 1)], "k string, v int")
    got = sorted(round(r["percent_rank"] * 100, 1) for r in d.with_percent_rank(df, ["k"], "v").collect())
    assert got == [0.0, 0.0, 0.0, 66.7, 100.0]


@pytest.mark.parametrize("values", [[0.1 * i for i in range(101)], [5.0] * 4, [1.0, 2.0, 987.0], [-3.0, 0.0, 7.7]])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = d.histogram(df, "v", 10).orderBy("bin").toPandas()
    n, edges = np.histogram(values, bins=10)
    assert got["n"].tolist() == n.tolist()
    assert got["bin_low"].tolist() == pytest.approx(edges[:-1].tolist())


def test_histogram_by_group_shares_bounds(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 10.0), ("c", 99.0)], "g string, v double")
    got = d.histogram(df.where("g <> 'c'"), "v", 5, by="g", groups=["a", "b"]).toPandas()
    assert len(got) == 10 and got["n"].sum() == 2
    assert got.loc[got["g"] == "b", "bin_low"].max() == 8.0


@pytest.mark.parametrize("k", [200, 2_000])
def test_a_heavy_value_does_not_keep_a_slice_large(spark, k):
    df = spark.range(40_000).select(
        F.when(F.col("id") % 5 < 3, F.lit(0.5)).otherwise(F.col("id") / 40_000).alias("v")
    )
    values = np.sort(df.toPandas()["v"].to_numpy())
    probs = {"q": 0.1, "low": 0.25, "mid": 0.5, "high": 0.9, "top": 1.0}
    slices = [d._Slice("v", n, p * (len(values) - 1), len(values)) for n, p in probs.items()]
    d._narrow(df, slices, 1_000, k)
    assert all(s.found is not None or s.size <= 1_000 for s in slices)
    got, _ = d.wide_quantiles(df, ["v"], probs, 1_000, k)
    assert {r["q"]: r["value"] for r in got.collect()} == pytest.approx({n: np.quantile(values, p) for n, p in probs.items()})


def test_a_rank_between_two_heavy_values(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 300 + [2.0] * 300 + [float(x) for x in range(10, 210)]], "v double")
    got, _ = d.wide_quantiles(df, ["v"], {"q": 299.5 / 799}, 20, 200)
    assert got.first()["value"] == pytest.approx(1.5)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_gives_the_same_rows_on_every_path(spark, skewed, how):
    _, df = skewed
    df = df.withColumn("k", F.when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("k")))
    table = df.where("k is not null and k <> '3'").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    small = attach(df, table, ["k"], "n", how)
    large = attach(df, table, ["k"], "n", how, broadcast_rows=1, hot_keys=2)
    assert small.columns == large.columns
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0


def test_attach_beyond_the_broadcast_size_spreads_hot_rows(spark, skewed):
    """No task of the shuffled join may get the hot key's rows, a third of all."""
    _, df = skewed
    rows = df.repartition(16)
    table = df.groupBy("k").agg(F.count("*").alias("n"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        joined = attach(rows, table.withColumn("top", F.lit(1)), ["k"], "n", broadcast_rows=1, hot_keys=2)
        sizes = joined.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sizes.sum() == 3_000 and sizes.max() < 600


def test_attach_spreads_a_frequent_key_that_the_table_lacks(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 3_000).alias("k"))
    table = spark.range(3_000).select(F.col("id").alias("k"), F.lit(1).alias("n"), (F.col("id") * 2).alias("top"))
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        joined = attach(rows, table, ["k"], "n", broadcast_rows=1, hot_keys=2)
        sizes = joined.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        known = joined.where("top = 2 * k").count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert known == 10_000 and sizes.sum() == 20_000 and sizes.max() < 5_000


def test_results_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    a = d.quantiles(df.repartition(1), ["k"], "v", {"m": 0.5})
    b = d.quantiles(df.repartition(13), ["k"], "v", {"m": 0.5})
    assert a.exceptAll(b).count() == 0


@pytest.fixture(scope="module")
def spread(spark):
    """One group with half of the rows, nearly all values different; a null group, repeats, a small group."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("g"),
        F.when(F.col("id") % 5 == 0, 77).otherwise((F.xxhash64("id") % 1_000_000)).cast("double").alias("x"),
    )
    return rows.union(spark.createDataFrame([("lone", 3.0)], "g string, x double")).cache()


def test_large_groups_are_counted_by_ranges(spread):
    limit = 2_000
    counts = d.value_counts(spread, ["g"], "x")
    ranked = d.running_counts(counts, ["g"], "x", limit)
    plain = d.running_counts(counts, ["g"], "x")
    assert sorted(map(tuple, ranked.collect()), key=str) == sorted(map(tuple, plain.select(ranked.columns).collect()), key=str)
    assert counts.where("g = 'hot'").count() > 7 * limit
    # The window's groups are the ranges of a key; none reaches the limit.
    dealt = ranked.groupBy("g", F.spark_partition_id().alias("task")).count().where("g = 'hot'")
    assert dealt.count() > 3
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_quantiles_and_ranks_by_ranges(spread):
    got = d.quantiles_from_counts(d.value_counts(spread, ["g"], "x"), ["g"], "x", {"q": 0.37, "m": 0.5}, limit=1_500)
    want = spread.groupBy("g").agg(F.percentile("x", 0.37).alias("q"), F.percentile("x", 0.5).alias("m"))
    key = lambda r: str(r["g"])
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert a["g"] == b["g"] and (a["q"], a["m"]) == pytest.approx((b["q"], b["m"]))
    ranks = d.percent_rank_table(spread, ["g"], "x", limit=1_500)
    plain = d.percent_rank_table(spread, ["g"], "x")
    assert ranks.count() == plain.count() and ranks.exceptAll(plain.select(ranks.columns)).count() == 0


def test_no_keys_and_no_rows(spread):
    counts = d.value_counts(spread, [], "x")
    a, b = (d.running_counts(counts, [], "x", n) for n in (3_000, 10**6))
    assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()
    assert d.running_counts(counts.limit(0), [], "x", 5).count() == 0
