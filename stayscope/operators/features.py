"""Engineered listing features. All but the area medians fold into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up, right_closed_bins
from stayscope.operators.distribution import quantiles_from_counts
from stayscope.operators.lookup import attach
from stayscope.schema import (
    AVAILABILITY_EDGES,
    AVAILABILITY_LABELS,
    LONG_TERM_MIN_NIGHTS,
    PRICE_EDGES,
    PRICE_LABELS,
    REFERENCE_DATE,
    SUPERHOST_MIN_LISTINGS,
)

# The five flags and ratios that scoring requests share with listings.


def reviewed_flag() -> Column:
    return F.coalesce(F.col("number_of_reviews") > 0, F.lit(False)).cast("int")


def superhost_flag(min_listings: int = SUPERHOST_MIN_LISTINGS) -> Column:
    enough = F.col("calculated_host_listings_count") >= min_listings
    return F.coalesce(enough, F.lit(False)).cast("int")


def availability_share() -> Column:
    return F.round(F.col("availability_365") / F.lit(365.0), 4)


def long_term_flag(min_nights: int = LONG_TERM_MIN_NIGHTS) -> Column:
    return F.coalesce(F.col("minimum_nights") >= min_nights, F.lit(False)).cast("int")


def add_price_per_review(df: DataFrame) -> DataFrame:
    """Price over review count, 0 for listings without reviews."""
    per_review = half_up(F.try_divide(F.col("price"), F.col("number_of_reviews")), 2)
    return df.withColumn(
        "price_per_review", F.when(F.col("number_of_reviews") > 0, per_review).otherwise(0.0)
    )


def add_is_reviewed(df: DataFrame) -> DataFrame:
    return df.withColumn("is_reviewed", reviewed_flag())


def add_superhost_proxy(df: DataFrame, min_listings: int = SUPERHOST_MIN_LISTINGS) -> DataFrame:
    return df.withColumn("host_is_superhost_proxy", superhost_flag(min_listings))


def add_availability_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("availability_ratio", availability_share())


def add_availability_category(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "availability_category",
        right_closed_bins(F.col("availability_365"), AVAILABILITY_EDGES, AVAILABILITY_LABELS),
    )


def add_review_score_category(df: DataFrame) -> DataFrame:
    """Review pace in words; a missing pace counts as High, as every comparison fails."""
    rpm = F.col("reviews_per_month")
    return df.withColumn(
        "review_score_category",
        F.when(rpm == 0, "No Reviews").when(rpm <= 1, "Low").when(rpm <= 3, "Medium").otherwise("High"),
    )


def add_price_category(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "price_category", right_closed_bins(F.col("price"), PRICE_EDGES, PRICE_LABELS)
    )


def add_is_long_term(df: DataFrame, min_nights: int = LONG_TERM_MIN_NIGHTS) -> DataFrame:
    return df.withColumn("is_long_term", long_term_flag(min_nights))


def add_name_length(df: DataFrame) -> DataFrame:
    return df.withColumn("name_length", F.length(F.coalesce("name", F.lit(""))))


def add_date_features(df: DataFrame, reference_date: str = REFERENCE_DATE) -> DataFrame:
    seen = F.col("last_review")
    return df.withColumns(
        {
            "last_review_year": F.year(seen),
            "last_review_month": F.month(seen),
            "days_since_last_review": F.datediff(F.lit(reference_date).cast("date"), seen),
        }
    )


def area_medians(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Median price per neighbourhood and per borough, each with its row count ``n``."""
    tables = []
    for key in ("neighbourhood", "neighbourhood_group"):
        counts = (
            df.where(F.col("price").isNotNull() & F.col(key).isNotNull())
            .groupBy(key, "price")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        tables.append(
            quantiles_from_counts(
                counts, [key], "price", {f"{key}_median_price": 0.5}, F.sum("n").alias("n")
            )
        )
    return tables[0], tables[1]


def add_area_price_encoding(
    df: DataFrame, fit_on: DataFrame | None = None, medians: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Median price of the listing's neighbourhood and borough.

    Medians come from all rows by default, prices of test rows included; ``fit_on`` fits
    them on a training part and ``medians`` reuses saved tables.
    """
    saved = medians is not None
    by_area, by_borough = medians if saved else area_medians(df if fit_on is None else fit_on)
    order = df.columns
    out = attach(df, by_area, ["neighbourhood"], weight="n", staged=saved)
    out = attach(out, by_borough, ["neighbourhood_group"], weight="n", staged=saved)
    return out.select(*order, "neighbourhood_median_price", "neighbourhood_group_median_price")


def row_features(df: DataFrame, reference_date: str = REFERENCE_DATE) -> DataFrame:
    """Every feature that needs its own row only."""
    return (
        df.transform(add_price_per_review)
        .transform(add_is_reviewed)
        .transform(add_superhost_proxy)
        .transform(add_availability_ratio)
        .transform(add_availability_category)
        .transform(add_review_score_category)
        .transform(add_price_category)
        .transform(add_is_long_term)
        .transform(add_name_length)
        .transform(add_date_features, reference_date)
    )


def engineer_features(
    df: DataFrame,
    reference_date: str = REFERENCE_DATE,
    fit_on: DataFrame | None = None,
    medians: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """All features, the area medians last."""
    return df.transform(row_features, reference_date).transform(
        add_area_price_encoding, fit_on if fit_on is not None else df, medians
    )
