"""Cleaning steps. Order matters: see ``clean``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayscope.functions.text import strip, title_case
from stayscope.operators.distribution import quantiles_from_counts
from stayscope.schema import CAP_QUANTILE, UNKNOWN_TEXT
from stayscope.sources.staging import stage


def drop_zero_prices(df: DataFrame) -> DataFrame:
    """Keep rows with a price above 0; missing and negative prices go too."""
    return df.where(F.col("price") > 0)


def cap_thresholds(
    df: DataFrame, columns: tuple[str, ...] = ("price", "minimum_nights"), q: float = CAP_QUANTILE
) -> DataFrame:
    """(column, cap): the exact ``q`` quantile of each column, one pass for all of them."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    )
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where(F.col("v").isNotNull())
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return quantiles_from_counts(counts, ["column"], "v", {"cap": q})


def cap_columns(
    df: DataFrame, columns: tuple[str, ...], q: float = CAP_QUANTILE, caps: DataFrame | None = None
) -> DataFrame:
    """``min(value, cap)`` per column. ``caps`` reuses saved thresholds, else they are
    computed from ``df``; either way they enter the plan as one scalar value."""
    caps = caps if caps is not None else cap_thresholds(df, columns, q)
    found = caps.agg(F.map_from_entries(F.collect_list(F.struct("column", "cap"))).alias("caps"))
    scalar = found.scalar()
    capped = {
        c: F.when(
            F.col(c).isNotNull(), F.least(F.col(c).cast("double"), F.col("_caps")[F.lit(c)])
        )
        for c in columns
    }
    return df.withColumn("_caps", scalar).withColumns(capped).drop("_caps")


def cap_price(df: DataFrame, q: float = CAP_QUANTILE) -> DataFrame:
    return cap_columns(df, ("price",), q)


def cap_minimum_nights(df: DataFrame, q: float = CAP_QUANTILE) -> DataFrame:
    return cap_columns(df, ("minimum_nights",), q)


def fill_missing_text(df: DataFrame) -> DataFrame:
    return df.fillna(UNKNOWN_TEXT, subset=["name", "host_name"])


def fix_reviews(df: DataFrame) -> DataFrame:
    """No reviews means 0 per month; the review date stays missing instead of a placeholder."""
    return df.fillna(0.0, subset=["reviews_per_month"])


def parse_last_review(df: DataFrame) -> DataFrame:
    """Text to date; what is not a date becomes null."""
    return df.withColumn("last_review", F.col("last_review").try_cast("date"))


def strip_whitespace(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: strip(F.col(c)) for c in text})


def title_case_areas(
    df: DataFrame, columns: tuple[str, ...] = ("neighbourhood_group", "neighbourhood")
) -> DataFrame:
    return df.withColumns({c: title_case(F.col(c)) for c in columns})


def clean(df: DataFrame, dedupe: bool = False, caps: DataFrame | None = None) -> DataFrame:
    """All steps in order: drop, cap, fill, parse, strip, re-case.

    Exact duplicates stay unless ``dedupe`` is set. Blank names are filled before the
    strip, so a name of blanks ends up empty, not 'Unknown'.
    """
    if dedupe:
        df = df.dropDuplicates()
    return (
        df.transform(drop_zero_prices)
        .transform(cap_columns, ("price", "minimum_nights"), CAP_QUANTILE, caps)
        .transform(fill_missing_text)
        .transform(fix_reviews)
        .transform(parse_last_review)
        .transform(strip_whitespace)
        .transform(title_case_areas)
    )


def with_row_index(df: DataFrame, key: str = "id") -> DataFrame:
    """Consecutive 0-based numbers in key order; equal keys get some order of their own.

    Counts per range of a range-sorted table give each range its start, so no task has to
    see all rows. A row number breaks ties, so copies of one key may span ranges. The
    ranges are written first: numbering needs one fixed layout.
    """
    ordered = [key, "_tie"]
    ranged = stage(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*ordered)
        .withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*ordered)) - 1
    return (
        ranged.withColumn("_within", within)
        .join(F.broadcast(starts), "_range")  # one row per shuffle partition
        .withColumn("row_index", (F.col("_start") + F.col("_within")).cast("long"))
        .drop("_range", "_within", "_start", "_tie")
    )
