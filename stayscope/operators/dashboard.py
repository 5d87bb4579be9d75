"""Datasets of the interactive pages, as functions of the page's filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up, row_count
from stayscope.operators.distribution import (
    histogram,
    quantiles,
    quantiles_from_counts,
    value_counts,
    weighted_mean,
)
from stayscope.operators.eda import avg_price_borough, room_type_counts, top15_neighbourhoods
from stayscope.operators.lookup import attach


def kpis(df: DataFrame) -> DataFrame:
    median = quantiles(df, [], "price", {"median_price": 0.5}).scalar()
    return df.agg(
        row_count().alias("total_listings"),
        F.countDistinct("host_id").alias("unique_hosts"),
        F.countDistinct("neighbourhood").alias("neighbourhoods"),
        half_up(F.avg("price"), 4).alias("avg_price"),
    ).withColumn("median_price", median)


def market_by_borough(df: DataFrame) -> DataFrame:
    """Borough table of the home page, from (borough, price) counts."""
    counts = (
        df.where(F.col("neighbourhood_group").isNotNull())
        .groupBy("neighbourhood_group", "price")
        .agg(
            F.count(F.when(F.col("price").isNotNull(), 1)).alias("n"),
            F.count("id").alias("ids"),
            F.sum("availability_365").alias("days"),
            F.count("availability_365").alias("with_days"),
        )
    )
    return (
        quantiles_from_counts(
            counts,
            ["neighbourhood_group"],
            "price",
            {"median": 0.5},
            F.sum("ids").alias("Listings"),
            half_up(weighted_mean("price"), 2).alias("Avg_Price"),
            half_up(F.sum("days") / F.sum("with_days"), 2).alias("Avg_Availability"),
        )
        .select(
            F.col("neighbourhood_group").alias("Borough"),
            "Listings",
            "Avg_Price",
            half_up(F.col("median"), 2).alias("Median_Price"),
            "Avg_Availability",
        )
        .orderBy(F.desc("Avg_Price"), "Borough")
    )


def filter_listings(
    df: DataFrame,
    boroughs: list[str] | None = None,
    room_types: list[str] | None = None,
    low: float = 10,
    high: float = 400,
) -> DataFrame:
    """Rows in the chosen boroughs and room types with low <= price <= high; None = all."""
    keep = F.col("price").between(low, high)
    for column, chosen in (("neighbourhood_group", boroughs), ("room_type", room_types)):
        keep &= F.col(column).isNotNull() if chosen is None else F.col(column).isin(chosen)
    return df.where(keep)


def filter_options(df: DataFrame) -> DataFrame:
    """(option, value) rows: boroughs, room types, and the whole-number price bounds."""
    pairs = F.array(
        *[
            F.struct(F.lit(o).alias("option"), F.col(c).alias("value"))
            for o, c in (("borough", "neighbourhood_group"), ("room_type", "room_type"))
        ]
    )
    choices = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
    bounds = df.agg(F.min("price").cast("int").alias("lo"), F.max("price").cast("int").alias("hi"))
    limits = bounds.select(
        F.explode(
            F.array(
                F.struct(F.lit("price_min").alias("option"), F.col("lo").cast("string").alias("value")),
                F.struct(F.lit("price_max").alias("option"), F.col("hi").cast("string").alias("value")),
            )
        ).alias("p")
    ).select("p.*")
    return choices.unionByName(limits)


def filtered_histogram(df: DataFrame, bins: int = 60, **filters) -> DataFrame:
    return histogram(filter_listings(df, **filters), "price", bins)


def filtered_room_mix(df: DataFrame, **filters) -> DataFrame:
    return room_type_counts(filter_listings(df, **filters)).drop("pct")


def filtered_borough_avg(df: DataFrame, **filters) -> DataFrame:
    return avg_price_borough(filter_listings(df, **filters))


def filtered_top15(df: DataFrame, min_listings: int = 30, **filters) -> DataFrame:
    return top15_neighbourhoods(filter_listings(df, **filters), min_listings)


def filtered_borough_room(df: DataFrame, **filters) -> DataFrame:
    return (
        filter_listings(df, **filters)
        .groupBy("neighbourhood_group", "room_type")
        .agg(half_up(F.avg("price"), 4).alias("avg_price"))
    )


def areas_of_borough(df: DataFrame, borough: str) -> DataFrame:
    return (
        df.where(F.col("neighbourhood_group") == borough)
        .select("neighbourhood")
        .distinct()
        .orderBy("neighbourhood")
    )


def compare_areas(df: DataFrame, area_a: str, area_b: str) -> DataFrame:
    """Metric rows with one column per area. Areas are matched by name alone."""
    picked = df.where(F.col("neighbourhood").isin(area_a, area_b))
    counts = picked.groupBy("neighbourhood", "price").agg(
        F.count(F.when(F.col("price").isNotNull(), 1)).alias("n"),
        row_count().alias("rows"),
        F.sum("availability_365").alias("days"),
        F.count("availability_365").alias("with_days"),
        F.sum("number_of_reviews").alias("reviews"),
        F.count("number_of_reviews").alias("with_reviews"),
    )
    stats = quantiles_from_counts(
        counts,
        ["neighbourhood"],
        "price",
        {"median": 0.5},
        F.sum("rows").alias("rows"),
        weighted_mean("price").alias("mean"),
        (F.sum("days") / F.sum("with_days")).alias("days"),
        (F.sum("reviews") / F.sum("with_reviews")).alias("reviews"),
    )
    metrics = {
        "Total Listings": (F.col("rows").cast("double"), 0),
        "Avg Price": (F.col("mean"), 2),
        "Median Price": (F.col("median"), 2),
        "Avg Availability": (F.col("days"), 2),
        "Avg Reviews": (F.col("reviews"), 2),
    }
    cells = [
        F.struct(F.lit(m).alias("metric"), half_up(c, d).alias("value")) for m, (c, d) in metrics.items()
    ]
    side = F.when(F.col("neighbourhood") == area_a, "area_a").otherwise("area_b")
    return (
        stats.select(side.alias("side"), F.explode(F.array(*cells)).alias("c"))
        .groupBy("c.metric")
        .pivot("side", ["area_a", "area_b"])
        .agg(F.max("c.value"))
    )


def compare_area_hist(df: DataFrame, area_a: str, area_b: str, bins: int = 40) -> DataFrame:
    """Price histogram of each area on shared bounds."""
    picked = df.where(F.col("neighbourhood").isin(area_a, area_b))
    return histogram(picked, "price", bins, by="neighbourhood", groups=[area_a, area_b])


def compare_room_mix(df: DataFrame, area_a: str, area_b: str) -> DataFrame:
    return (
        df.where(F.col("neighbourhood").isin(area_a, area_b))
        .groupBy("neighbourhood", "room_type")
        .agg(row_count().alias("n"))
    )


def benchmark_price(
    scored: DataFrame, listings: DataFrame, price: str = "predicted_price", min_rows: int = 5
) -> DataFrame:
    """Each scored row against the listings of its neighbourhood and room type.

    Group figures need ``min_rows`` listings, else they are null. ``pct_cheaper`` counts
    strictly cheaper listings. Both sides shrink to distinct prices before they meet: the
    window orders at most the distinct prices of a group, predictions before listings of
    the same price, and the answers are looked up per (group, prediction).
    """
    keys = ["neighbourhood", "room_type"]
    listed = value_counts(listings, keys, "price").select(*keys, F.col("price").alias("p"), "n")
    stats = quantiles_from_counts(
        listed,
        keys,
        "p",
        {"median": 0.5},
        F.sum("n").alias("listings"),
        weighted_mean("p").alias("mean"),
        F.min("p").alias("lowest"),
        F.max("p").alias("highest"),
    )
    asked = (
        scored.where(F.col(price).isNotNull())
        .groupBy(*keys, F.col(price).alias("p"))
        .agg(row_count().alias("asked"))
    )
    line = Window.partitionBy(*keys).orderBy("p", F.desc("asked"))
    merged = listed.withColumn("asked", F.lit(0).cast("long")).unionByName(
        asked.withColumn("n", F.lit(0).cast("long"))
    )
    cheaper = (
        merged.withColumn(
            "cheaper",
            F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
        .where(F.col("asked") > 0)
        .join(stats, keys, "left")
    )
    enough = F.col("listings") >= min_rows
    answers = cheaper.select(
        *keys,
        F.col("p").alias(price),
        "asked",
        F.when(enough, half_up(F.col("median"), 2)).alias("area_median"),
        F.when(enough, half_up(F.col("mean"), 2)).alias("area_mean"),
        F.when(enough, F.col("lowest")).alias("area_min"),
        F.when(enough, F.col("highest")).alias("area_max"),
        F.when(enough, half_up(F.col("cheaper") * 100.0 / F.col("listings"), 2)).alias("pct_cheaper"),
    )
    return attach(scored, answers, [*keys, price], weight="asked")
