"""Market reports over the featured table.

Means are rounded half up in decimal. Ties in a ranking are broken by the group key, so a
cut-off always keeps the same rows. Medians work on (group, price) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up, pct, row_count
from stayscope.operators.distribution import (
    quantiles,
    quantiles_from_counts,
    value_counts,
    weighted_mean,
    with_percent_rank,
)


def borough() -> Column:
    return F.col("neighbourhood_group").alias("borough")


def overall() -> WindowSpec:
    """All rows of an already aggregated table."""
    return Window.partitionBy()


def _mean(column: str, digits: int = 2):
    return half_up(F.avg(column), digits)


def market_summary(df: DataFrame) -> DataFrame:
    """One row: size of the market, price range, mean and median, availability."""
    median = quantiles(df, [], "price", {"median_price": 0.5}).scalar()
    return df.agg(
        row_count().alias("total_listings"),
        F.countDistinct("host_id").alias("total_hosts"),
        F.countDistinct("neighbourhood").alias("total_neighbourhoods"),
        _mean("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        _mean("availability_365", 1).alias("avg_availability_days"),
    ).withColumn("median_price", median)


def borough_summary(df: DataFrame) -> DataFrame:
    """Size, prices and market share per borough, dearest first."""
    grouped = df.groupBy(borough()).agg(
        row_count().alias("total_listings"),
        _mean("price").alias("avg_price"),
        half_up(F.min("price"), 2).alias("min_price"),
        half_up(F.max("price"), 2).alias("max_price"),
    )
    share = pct(F.col("total_listings"), F.sum("total_listings").over(overall()))
    return grouped.withColumn("market_share_pct", share).orderBy(F.desc("avg_price"), "borough")


def room_type_breakdown(df: DataFrame) -> DataFrame:
    """Size, mean, median and share per room type, from one pass of price counts."""
    counts = value_counts(df.select("room_type", "price"), ["room_type"], "price")
    grouped = quantiles_from_counts(
        counts,
        ["room_type"],
        "price",
        {"median": 0.5},
        F.sum("n").alias("listing_count"),
        half_up(weighted_mean("price"), 2).alias("avg_price"),
    )
    share = pct(F.col("listing_count"), F.sum("listing_count").over(overall()))
    return grouped.select(
        "room_type",
        "listing_count",
        "avg_price",
        half_up(F.col("median"), 2).alias("median_price"),
        share.alias("share_pct"),
    ).orderBy(F.desc("listing_count"), "room_type")


def top_neighbourhoods(df: DataFrame, min_listings: int = 30, top: int = 15) -> DataFrame:
    """Dearest (neighbourhood, borough) pairs with enough listings."""
    keys = ["neighbourhood", "borough"]
    rows = df.select("neighbourhood", borough(), "price")
    return (
        quantiles_from_counts(
            value_counts(rows, keys, "price"),
            keys,
            "price",
            {"median": 0.5},
            F.sum("n").alias("listing_count"),
            half_up(weighted_mean("price"), 2).alias("avg_price"),
        )
        .where(F.col("listing_count") >= min_listings)
        .select(*keys, "listing_count", "avg_price", half_up(F.col("median"), 2).alias("median_price"))
        .orderBy(F.desc("avg_price"), *keys)
        .limit(top)
    )


def price_category_mix(df: DataFrame) -> DataFrame:
    """Listings per price category and their share within the borough."""
    within = Window.partitionBy("borough")
    return (
        df.where(F.col("price_category").isNotNull())
        .groupBy(borough(), "price_category")
        .agg(row_count().alias("listing_count"))
        .withColumn(
            "pct_within_borough", pct(F.col("listing_count"), F.sum("listing_count").over(within))
        )
        .orderBy("borough", F.desc("listing_count"), "price_category")
    )


def room_type_crosstab(df: DataFrame) -> DataFrame:
    """Mean price of each room type side by side, whole units, per borough."""
    columns = {
        "Entire home/apt": "avg_entire_home",
        "Private room": "avg_private_room",
        "Shared room": "avg_shared_room",
    }
    wide = (
        df.groupBy(borough())
        .pivot("room_type", list(columns))
        .agg(half_up(F.avg("price"), 0))
        .withColumnsRenamed(columns)
    )
    return wide.orderBy(F.desc_nulls_first("avg_entire_home"), "borough")


def top_hosts(df: DataFrame, top: int = 10) -> DataFrame:
    """Hosts with the most listings."""
    return (
        df.groupBy("host_id", "host_name")
        .agg(
            row_count().alias("listing_count"),
            _mean("price").alias("avg_price"),
            _mean("number_of_reviews", 1).alias("avg_reviews"),
            _mean("availability_365", 1).alias("avg_availability"),
        )
        .orderBy(F.desc("listing_count"), "host_id", "host_name")
        .limit(top)
    )


def superhost_compare(df: DataFrame) -> DataFrame:
    """Hosts with five or more listings against the others."""
    label = F.when(
        F.col("host_is_superhost_proxy") == 1, "Proxy Superhost (5+ listings)"
    ).otherwise("Regular Host (1–4 listings)")
    return (
        df.groupBy(label.alias("host_type"))
        .agg(
            F.countDistinct("host_id").alias("host_count"),
            row_count().alias("total_listings"),
            _mean("price").alias("avg_price"),
            _mean("number_of_reviews", 1).alias("avg_reviews"),
            _mean("availability_365", 1).alias("avg_availability"),
        )
        .orderBy("host_type")
    )


def most_reviewed_hosts(df: DataFrame, min_listings: int = 3, top: int = 10) -> DataFrame:
    """Hosts by mean review count; hosts are told apart by id, only names are shown."""
    return (
        df.groupBy("host_id", "host_name")
        .agg(
            row_count().alias("listing_count"),
            _mean("number_of_reviews", 1).alias("avg_reviews_per_listing"),
            F.sum("number_of_reviews").alias("total_reviews"),
            _mean("price").alias("avg_price"),
        )
        .where(F.col("listing_count") >= min_listings)
        .orderBy(F.desc("avg_reviews_per_listing"), "host_id", "host_name")
        .limit(top)
        .drop("host_id")
    )


def _category_mix(df: DataFrame, category: str) -> DataFrame:
    grouped = df.groupBy(category).agg(
        row_count().alias("listing_count"), _mean("price").alias("avg_price")
    )
    share = pct(F.col("listing_count"), F.sum("listing_count").over(overall()))
    return grouped.withColumn("share_pct", share).orderBy(F.desc("listing_count"), category)


def availability_mix(df: DataFrame) -> DataFrame:
    return _category_mix(df.where(F.col("availability_category").isNotNull()), "availability_category")


def review_category_mix(df: DataFrame) -> DataFrame:
    return _category_mix(df, "review_score_category")


def availability_by_area_type(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(borough(), "room_type")
        .agg(
            _mean("availability_365", 1).alias("avg_days_available"),
            _mean("price").alias("avg_price"),
            row_count().alias("listing_count"),
        )
        .orderBy("borough", "avg_days_available", "room_type")
    )


def review_activity(df: DataFrame) -> DataFrame:
    """Review totals and the share of reviewed listings per borough."""
    reviewed = F.count_if(F.col("is_reviewed") == 1)
    return (
        df.groupBy(borough())
        .agg(
            row_count().alias("total_listings"),
            F.sum("number_of_reviews").alias("total_reviews"),
            _mean("number_of_reviews", 1).alias("avg_reviews"),
            _mean("reviews_per_month").alias("avg_reviews_per_month"),
            reviewed.alias("listings_with_reviews"),
            pct(reviewed, row_count()).alias("pct_reviewed"),
        )
        .orderBy(F.desc("avg_reviews_per_month"), "borough")
    )


def _area_prices(df: DataFrame, min_listings: int) -> DataFrame:
    return (
        df.groupBy("neighbourhood", borough())
        .agg(row_count().alias("listing_count"), _mean("price").alias("avg_price"))
        .where(F.col("listing_count") >= min_listings)
    )


def rank_in_borough(df: DataFrame, min_listings: int = 20, top: int | None = 30) -> DataFrame:
    """Price rank of each neighbourhood inside its borough; ranks are over areas, not rows."""
    place = F.rank().over(Window.partitionBy("borough").orderBy(F.desc("avg_price")))
    ranked = _area_prices(df, min_listings).withColumn("price_rank_within_borough", place)
    ordered = ranked.orderBy("borough", "price_rank_within_borough", "neighbourhood")
    return ordered.limit(top) if top else ordered


def running_totals(df: DataFrame, min_listings: int = 30, top: int | None = 20) -> DataFrame:
    """Listings accumulated from the dearest area down, with a three-area mean price.

    Areas with equal means share one running total; the three-area mean needs a full order,
    so the area name breaks ties there. The windows see one row per area.
    """
    ranged = Window.orderBy(F.desc("avg_price"))
    three = Window.orderBy(F.desc("avg_price"), "neighbourhood", "borough").rowsBetween(-2, 0)
    ordered = (
        _area_prices(df, min_listings)
        .withColumn("cumulative_listings", F.sum("listing_count").over(ranged))
        .withColumn("rolling_3_avg_price", half_up(F.avg("avg_price").over(three), 2))
        .orderBy(F.desc("avg_price"), "neighbourhood", "borough")
    )
    return ordered.limit(top) if top else ordered


def price_percentile(df: DataFrame, top: int | None = 20) -> DataFrame:
    """Percent rank of each listing's price in its borough, from (borough, price) counts."""
    rows = df.select("id", "name", borough(), "room_type", "price")
    ranked = with_percent_rank(rows, ["borough"], "price").select(
        *rows.columns,
        half_up(F.col("percent_rank") * 100, 1).alias("price_percentile_in_borough"),
    )
    ordered = ranked.orderBy("borough", F.desc("price_percentile_in_borough"), "id")
    return ordered.limit(top) if top else ordered
