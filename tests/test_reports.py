from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up
from stayscope.operators import dashboard as db
from stayscope.operators import eda
from stayscope.operators import market as mk
from stayscope.operators import profile as pf


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 1.0, "b")], "i int, x double, s string")
    assert pf.duplicates(df).first()[0] == 1
    assert pf.duplicates(df.limit(0)).first()[0] == 0


def test_numeric_summary_matches_describe(workspace):
    got = pf.numeric_summary(workspace.raw).toPandas().set_index("column_name")
    expected = workspace.raw.toPandas()[got.index.tolist()].describe().T
    pairs = {"count": "count", "mean": "mean", "std": "std", "min": "min", "max": "max",
             "p25": "25%", "p50": "50%", "p75": "75%"}
    for ours, theirs in pairs.items():
        assert got[ours].tolist() == pytest.approx(expected[theirs].tolist())


def test_text_price_is_flagged(spark):
    df = spark.createDataFrame([("$1,200.00",)], "Price string")
    row = pf.price_profile(df).first()
    assert row["needs_parsing"] and row["sample_value"] == "$1,200.00"
    with pytest.raises(ValueError):
        pf.price_profile(df.withColumnRenamed("Price", "cost"))


def test_correlation_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(500, 4)), columns=list("abcd"))
    pdf["b"] = pdf["a"] * 2 + pdf["b"] + 1e6
    pdf.loc[::5, "c"] = np.nan
    pdf.loc[::7, "d"] = np.nan
    pdf["e"] = 3.3
    got = eda.correlation_matrix(spark.createDataFrame(pdf).repartition(6), list("abcde"))
    wide = got.toPandas().pivot(index="column_a", columns="column_b", values="correlation")
    expected = pdf.corr()
    assert np.allclose(wide.loc[list("abcd"), list("abcd")], expected.loc[list("abcd"), list("abcd")], atol=1e-6)
    assert wide["e"].isna().all()


def test_running_total_shares_ties(spark):
    rows = [("x", "A", p, "r") for p in (2.0, 2.0)] + [("y", "A", 2.0, "r")] * 2 + [("z", "A", 1.0, "r")]
    df = spark.createDataFrame(rows, "neighbourhood string, neighbourhood_group string, price double, room_type string")
    got = mk.running_totals(df, min_listings=1).collect()
    assert [r["cumulative_listings"] for r in got] == [4, 4, 5]
    assert [r["rolling_3_avg_price"] for r in got] == [2.0, 2.0, 1.67]


def test_shares_add_up(workspace):
    for df, column in (
        (mk.borough_summary(workspace.featured), "market_share_pct"),
        (mk.availability_mix(workspace.featured), "share_pct"),
        (mk.review_category_mix(workspace.featured), "share_pct"),
    ):
        assert df.agg(F.sum(column)).first()[0] == pytest.approx(100, abs=0.5)


def test_crosstab_puts_missing_first(spark):
    rows = [("A", "Entire home/apt", 10.0), ("B", "Private room", 5.0)]
    df = spark.createDataFrame(rows, "neighbourhood_group string, room_type string, price double")
    assert [r["borough"] for r in mk.room_type_crosstab(df).collect()] == ["B", "A"]


def test_histograms_hold_every_row(workspace):
    n = workspace.featured.count()
    for df in (eda.hist_availability(workspace.featured), eda.hist_minimum_nights(workspace.featured)):
        assert df.agg(F.sum("n")).first()[0] == n


@pytest.mark.parametrize("size", [1, 700, 5_000])
def test_sample_size_is_exact(workspace, size):
    got = eda.sample_price_reviews(workspace.featured, size)
    assert got.count() == min(size, workspace.featured.count())


def test_sample_opens_its_limit_when_too_few_pass(spark):
    """Copies of few ids hash alike, so the first limit may pass nothing."""
    df = spark.range(4000).selectExpr(
        "id % 2 as id", "1 as number_of_reviews", "2.0D as price", "'r' as room_type"
    )
    assert eda.sample_price_reviews(df, 100).count() == 100


def test_category_columns_only_when_present(spark):
    rows = [("A", "Luxury"), ("A", "Budget"), ("B", "Luxury")]
    df = spark.createDataFrame(rows, "neighbourhood_group string, price_category string")
    got = eda.category_by_borough(df)
    assert got.columns == ["neighbourhood_group", "Budget", "Luxury"]
    assert [tuple(r) for r in got.collect()] == [("A", 1, 1), ("B", 0, 1)]


def test_benchmark_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    listed = pd.DataFrame({
        "neighbourhood": np.where(np.arange(400) % 3 == 0, "hot", rng.integers(0, 9, 400).astype(str)),
        "room_type": rng.choice(["p", "q"], 400),
        "price": rng.integers(1, 60, 400).astype(float),
    })
    scored = listed.iloc[:150][["neighbourhood", "room_type"]].reset_index(drop=True)
    scored["predicted_price"] = rng.integers(1, 60, 150).astype(float)
    scored.loc[0, "neighbourhood"] = "nowhere"
    scored["id"] = range(150)
    got = db.benchmark_price(spark.createDataFrame(scored), spark.createDataFrame(listed)).toPandas().set_index("id")
    assert len(got) == 150
    for _, r in scored.iterrows():
        group = listed[(listed.neighbourhood == r.neighbourhood) & (listed.room_type == r.room_type)].price
        row = got.loc[r.id]
        if len(group) < 5:
            assert np.isnan(row.area_median) and np.isnan(row.pct_cheaper)
        else:
            assert row.area_median == pytest.approx(group.median(), abs=0.005)
            assert row.pct_cheaper == pytest.approx((group < r.predicted_price).mean() * 100, abs=0.00501)


def test_filter_defaults_keep_all_groups(workspace):
    got = db.filter_listings(workspace.featured)
    assert got.count() == workspace.featured.where("price between 10 and 400").count()


def test_filters_reach_the_scan(spark, workspace):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2_000)
    plan = db.filter_listings(workspace.featured, ["Asia"], ["Private room"])._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(neighbourhood_group,Asia)" in pushed and "LessThanOrEqual(price,400" in pushed


def test_reports_read_only_their_columns(workspace):
    plan = mk.borough_summary(workspace.featured)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<neighbourhood_group:string,price:double>" in plan


def test_correlation_of_a_table_with_odd_beginnings(spark):
    """The first rows hold nulls or one value, and the numbers have a large offset."""
    rng = np.random.default_rng(1)
    n = 20_000
    a = 1e9 + rng.integers(0, 7, n).astype(float)
    b = a + rng.normal(size=n)
    c = np.where(np.arange(n) < 1_000, 5.0, rng.normal(size=n))
    a[:1_000] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c, "d": np.full(n, 3.3)})
    for parts in (1, 5):
        got = eda.correlation_matrix(spark.createDataFrame(pdf).repartition(parts), list("abcd")).collect()
        want = pdf.corr()
        for r in got:
            x, y = r["column_a"], r["column_b"]
            if "d" in (x, y):
                assert r["correlation"] is None
            else:
                assert abs(r["correlation"] - want.loc[x, y]) < 2e-6


def test_one_rounding_like_decimal(spark):
    values = [149.9949996, 0.0049999996, 0.285, 2.675, -1.005, 1e-9, 2e12, 2.5e12 + 0.125, 1e21, -0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_up(F.col("v"), 2).alias("r")).collect()
    for r in got:
        want = Decimal(repr(r["v"])).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP, context=Context(prec=60))
        assert r["r"] == float(want)
    odd = spark.createDataFrame([(1e30,), (float("inf"),), (None,)], "v double").select(half_up(F.col("v"), 2).alias("r"))
    assert [r["r"] for r in odd.collect()] == [1e30, float("inf"), None]
