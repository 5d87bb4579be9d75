import datetime

import pytest
from pyspark.sql import functions as F

from stayscope.operators import features as ft
from stayscope.operators.ml import train_test_split


def one_column(spark, fn, inputs, schema, output):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in inputs], schema)
    return [r[output] for r in fn(df).collect()]


def test_price_per_review(spark):
    got = one_column(
        spark, ft.add_price_per_review, [(200.0, 100), (200.0, 0), (1.0, 8)],
        "price double, number_of_reviews int", "price_per_review",
    )
    assert got == [2.0, 0.0, 0.13]


def test_availability_category(spark):
    days = [0, 30, 31, 90, 91, 180, 181, 365, -1, 366, None]
    got = one_column(
        spark, ft.add_availability_category, days, "availability_365 int", "availability_category"
    )
    labels = ["Rarely Available", "Occasionally", "Moderately", "Highly Available"]
    assert got == [x for x in labels for _ in range(2)] + [None] * 3


def test_review_score_category(spark):
    pace = [0.0, 0.01, 1.0, 1.01, 3.0, 3.01, None, float("nan")]
    got = one_column(
        spark, ft.add_review_score_category, pace, "reviews_per_month double", "review_score_category"
    )
    assert got == ["No Reviews", "Low", "Low", "Medium", "Medium", "High", "High", "High"]


def test_price_category(spark):
    prices = [0.0, 75.0, 75.5, 150.0, 151.0, 300.0, 300.5, 799.0, -1.0, None]
    got = one_column(spark, ft.add_price_category, prices, "price double", "price_category")
    assert got == [x for x in ("Budget", "Mid", "Premium", "Luxury") for _ in range(2)] + [None] * 2


def test_flags(spark):
    assert one_column(spark, ft.add_is_long_term, [29.0, 30.0], "minimum_nights double", "is_long_term") == [0, 1]
    assert one_column(
        spark, ft.add_superhost_proxy, [4, 5], "calculated_host_listings_count int", "host_is_superhost_proxy"
    ) == [0, 1]
    assert one_column(spark, ft.add_is_reviewed, [0, 1, None], "number_of_reviews int", "is_reviewed") == [0, 1, 0]


def test_name_length_counts_characters(spark):
    assert one_column(spark, ft.add_name_length, ["ab😀", None, ""], "name string", "name_length") == [3, 0, 0]


def test_availability_ratio(spark):
    got = one_column(spark, ft.add_availability_ratio, [0, 100, 365], "availability_365 int", "availability_ratio")
    assert got == [0.0, round(100 / 365, 4), 1.0]


def test_date_features(spark):
    df = spark.createDataFrame([(datetime.date(2019, 6, 23),), (None,)], "last_review date")
    cols = ("last_review_year", "last_review_month", "days_since_last_review")
    assert [tuple(r) for r in ft.add_date_features(df).select(*cols).collect()] == [
        (2019, 6, 16), (None, None, None),
    ]


def test_area_medians_match_pandas(spark, workspace):
    got = ft.add_area_price_encoding(workspace.cleaned).toPandas()
    for key in ("neighbourhood", "neighbourhood_group"):
        expected = got.groupby(key)["price"].transform("median")
        assert got[f"{key}_median_price"].tolist() == pytest.approx(expected.tolist())


def test_medians_fitted_on_train_only(spark, workspace):
    train, test = train_test_split(workspace.cleaned)
    got = ft.add_area_price_encoding(workspace.cleaned, fit_on=train).toPandas()
    expected = train.toPandas().groupby("neighbourhood_group")["price"].median()
    assert got.set_index("id")["neighbourhood_group_median_price"].equals(
        got.set_index("id")["neighbourhood_group"].map(expected).rename("neighbourhood_group_median_price")
    )


def test_categories_inside_range_are_never_null(workspace):
    assert workspace.featured.where(
        F.col("availability_category").isNull() | F.col("price_category").isNull()
    ).count() == 0
