"""The data behind each exploratory chart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayscope.functions.numeric import half_up, hash_number, pct, row_count
from stayscope.operators.distribution import (
    histogram,
    quantiles,
    quantiles_from_counts,
    value_counts,
)
from stayscope.schema import CORRELATION_COLUMNS, PRICE_LABELS, ROOM_TYPES


def hist_price(df: DataFrame, bins: int = 60, zoom_to: float = 400) -> DataFrame:
    """Price histogram, of all rows and of prices up to ``zoom_to``."""
    full = histogram(df, "price", bins).withColumn("view", F.lit("all"))
    near = histogram(df.where(F.col("price") <= zoom_to), "price", bins)
    return full.unionByName(near.withColumn("view", F.lit("zoomed")))


def box_price_room_type(df: DataFrame, whisker: float = 1.5) -> DataFrame:
    """Box plot numbers of price per room type in a fixed order, from price counts only."""
    counts = value_counts(df, ["room_type"], "price")
    boxes = quantiles_from_counts(
        counts, ["room_type"], "price", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    inside = F.col("price").between(F.col("q1") - reach, F.col("q3") + reach)
    place = F.array_position(F.array(*[F.lit(r) for r in ROOM_TYPES]), F.col("room_type"))
    return (
        counts.join(boxes, "room_type")
        .groupBy("room_type", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("price"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("price"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
        )
        .where(F.col("room_type").isin(ROOM_TYPES))
        .withColumn("position", place.cast("int"))
        .orderBy("position")
    )


def avg_price_borough(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("neighbourhood_group")
        .agg(half_up(F.avg("price"), 4).alias("avg_price"))
        .orderBy(F.desc("avg_price"), "neighbourhood_group")
    )


def top15_neighbourhoods(df: DataFrame, min_listings: int = 30, top: int = 15) -> DataFrame:
    """Dearest neighbourhood names with enough listings; boroughs are not told apart."""
    return (
        df.groupBy("neighbourhood")
        .agg(row_count().alias("listings"), half_up(F.avg("price"), 4).alias("avg_price"))
        .where(F.col("listings") >= min_listings)
        .orderBy(F.desc("avg_price"), "neighbourhood")
        .limit(top)
        .drop("listings")
    )


def room_type_counts(df: DataFrame) -> DataFrame:
    grouped = df.where(F.col("room_type").isNotNull()).groupBy("room_type").agg(row_count().alias("n"))
    share = pct(F.col("n"), F.sum("n").over(Window.partitionBy()))
    return grouped.withColumn("pct", share).orderBy(F.desc("n"), "room_type")


def hist_availability(df: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(df, "availability_365", bins)


def hist_reviews_per_month(df: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(df.where(F.col("reviews_per_month") > 0), "reviews_per_month", bins)


def hist_minimum_nights(df: DataFrame, bins: int = 45) -> DataFrame:
    return histogram(df, "minimum_nights", bins)


def _pair_moments(k: int):
    """Arrow task: count, means, squared deviations, co-deviation and range of every column pair
    over the rows where both are present. A task hands on one row per pair, whatever it read."""

    def of_batch(x: np.ndarray) -> dict[str, np.ndarray]:
        seen = ~np.isnan(x)
        m = seen.astype(float)
        n = m.T @ m
        rows = np.maximum(seen.sum(axis=0), 1)
        shift = np.where(seen, x, 0).sum(axis=0) / rows
        z = np.where(seen, x - shift, 0)
        s, q, c = z.T @ m, (z * z).T @ m, z.T @ z
        own = s / np.maximum(n, 1)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for b in range(k):
            both = np.where(seen & seen[:, [b]], x, np.nan)
            low[:, b] = np.fmin.reduce(both, axis=0, initial=np.inf)
            high[:, b] = np.fmax.reduce(both, axis=0, initial=-np.inf)
        return {"n": n, "mean": shift[:, None] + own, "sq": q - s * own, "co": c - s * own.T, "low": low, "high": high}

    def merged(one: dict, two: dict) -> dict:
        n = one["n"] + two["n"]
        some = np.maximum(n, 1)
        step = two["mean"] - one["mean"]
        weight = one["n"] * two["n"] / some
        return {
            "n": n,
            "mean": one["mean"] + step * two["n"] / some,
            "sq": one["sq"] + two["sq"] + step * step * weight,
            "co": one["co"] + two["co"] + step * step.T * weight,
            "low": np.minimum(one["low"], two["low"]),
            "high": np.maximum(one["high"], two["high"]),
        }

    def run(batches):
        total = None
        for batch in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in batch.columns])
            if len(x):
                total = of_batch(x) if total is None else merged(total, of_batch(x))
        if total is not None:
            a, b = np.triu_indices(k)
            ends = {"a": a.astype("int32"), "b": b.astype("int32"), "n": total["n"][a, b], "co": total["co"][a, b]}
            sides = {f"{c}_{side}": total[c][i, j] for side, i, j in (("a", a, b), ("b", b, a)) for c in _SIDES}
            yield pa.RecordBatch.from_pydict({**ends, **sides})

    return run


_SIDES = ("mean", "sq", "low", "high")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present.

    One pass and no job before it. Each task reduces its rows to means and deviations around them;
    these merge by the usual formulas for parts, so large offsets do not cancel. A column that is
    constant over the rows of a pair gives null.
    """
    names = [c for c in (columns or CORRELATION_COLUMNS) if c in df.columns]
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    fields = [f"{c}_{side} double" for side in "ab" for c in _SIDES]
    parts = numbers.mapInArrow(_pair_moments(len(names)), ", ".join(["a int, b int, n double, co double", *fields]))
    parts = parts.where(F.col("n") > 0)
    pair = Window.partitionBy("a", "b")
    for side in "ab":
        mean = F.sum(F.col("n") * F.col(f"mean_{side}")).over(pair) / F.sum("n").over(pair)
        parts = parts.withColumn(f"off_{side}", F.col(f"mean_{side}") - mean)

    def spread(side: str):
        total = F.sum(F.col(f"sq_{side}") + F.col("n") * F.col(f"off_{side}") * F.col(f"off_{side}"))
        return F.when(F.min(f"low_{side}") < F.max(f"high_{side}"), F.sqrt(total))

    together = F.sum(F.col("co") + F.col("n") * F.col("off_a") * F.col("off_b"))
    found = parts.groupBy("a", "b").agg(
        F.try_divide(together, spread("a") * spread("b")).alias("r")
    )
    label = F.array(*[F.lit(c) for c in names])
    every = df.sparkSession.range(len(names) * len(names)).select(
        (F.col("id") / len(names)).cast("int").alias("i"), (F.col("id") % len(names)).cast("int").alias("j")
    )
    # Every pair is there, also when no row has both; the table has a row per pair.
    return every.join(
        F.broadcast(found), (F.least("i", "j") == F.col("a")) & (F.greatest("i", "j") == F.col("b")), "left"
    ).select(
        label[F.col("i")].alias("column_a"),
        label[F.col("j")].alias("column_b"),
        half_up(F.col("r"), 6).alias("correlation"),
    )


def category_by_borough(df: DataFrame) -> DataFrame:
    """Listings per borough and price category, cheap to dear, absent pairs 0.

    Only categories that occur become columns; finding them takes one look at the few
    distinct labels.
    """
    labels = df.where(F.col("price_category").isin(PRICE_LABELS)).select("price_category").distinct()
    found = {r[0] for r in labels.take(len(PRICE_LABELS))}
    present = [c for c in PRICE_LABELS if c in found]
    return (
        df.where(F.col("price_category").isNotNull())
        .groupBy("neighbourhood_group")
        .pivot("price_category", present)
        .agg(row_count())
        .fillna(0)
        .orderBy("neighbourhood_group")
    )


def top_hosts_by_name(df: DataFrame, top: int = 10) -> DataFrame:
    """Hosts by listings, told apart by name only."""
    return (
        df.where(F.col("host_name").isNotNull())
        .groupBy("host_name")
        .agg(F.count("id").alias("listing_count"))
        .orderBy(F.desc("listing_count"), "host_name")
        .limit(top)
    )


def sample_price_reviews(df: DataFrame, size: int = 5_000, seed: int = 42) -> DataFrame:
    """Exactly min(size, rows) rows, the ones with the smallest key hashes.

    Only rows under a hash limit that should pass slightly more than ``size`` rows are
    sorted; should it pass fewer, the limit opens fully, so the sample is always exact.
    """
    whole = 1 << 32
    hashed = df.select(
        "id", "number_of_reviews", "price", "room_type", hash_number(F.col("id"), seed).alias("_h")
    )
    first = df.agg(
        F.ceil(F.try_divide(F.lit(whole * (1.25 * size + 200)), row_count())).cast("long")
    ).scalar()
    passing = hashed.agg(F.count_if(F.col("_h") <= first)).scalar()
    limit = F.when(passing >= size, first).otherwise(F.lit(whole))
    axis = quantiles(df, [], "number_of_reviews", {"p98": 0.98}).scalar()
    return (
        hashed.where(F.col("_h") <= limit)
        .orderBy("_h", "id")
        .limit(size)
        .drop("_h")
        .withColumn("reviews_p98", axis)
    )


def eda_all(df: DataFrame) -> dict[str, DataFrame]:
    """All twelve datasets of one featured table."""
    return {
        "hist_price": hist_price(df),
        "box_price_room_type": box_price_room_type(df),
        "avg_price_borough": avg_price_borough(df),
        "top15_neighbourhoods": top15_neighbourhoods(df),
        "room_type_counts": room_type_counts(df),
        "hist_availability": hist_availability(df),
        "hist_reviews_per_month": hist_reviews_per_month(df),
        "correlation_matrix": correlation_matrix(df),
        "category_by_borough": category_by_borough(df),
        "top_hosts_by_name": top_hosts_by_name(df),
        "hist_minimum_nights": hist_minimum_nights(df),
        "sample_price_reviews": sample_price_reviews(df),
    }
