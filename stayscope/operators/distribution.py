"""Exact quantiles, percent ranks and histograms that never gather rows of a group.

Columns such as prices in whole units repeat a lot, so rows are first collapsed to
(keys, value, n); everything after works on distinct values. ``wide_quantiles`` is for
columns where nearly every value differs, such as ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from stayscope.functions.numeric import row_count
from stayscope.operators.lookup import attach
from stayscope.sources.literal import literal_table
from stayscope.sources.staging import stage


def value_counts(df: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    """One row per (keys, value) with its row count ``n``; missing values left out.

    A value holding a third of all rows still costs one row per task in the shuffle.
    """
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


#: Rows of (keys, value, n) up to which a group's running counts may be one task's work.
RANGE_ROWS = 1_000_000


def running_counts(counts: DataFrame, keys: list[str], value: str, limit: int = RANGE_ROWS) -> DataFrame:
    """(keys, value, n) with ``_upto``, rows of the key up to the value, and ``_total``, all its rows.

    ``counts`` is written first, so its size is known. Up to ``limit`` rows it is a window per key. A larger
    table is cut into ranges of (keys, value) of about ``limit`` rows: running counts within
    a range, plus what the key has in the ranges before. A key in several ranges is the last of one and
    the first of the next, so the table of these offsets has at most two rows per range and is
    broadcast. Null keys are a group of their own.
    """
    counts = stage(counts, "value-counts")
    many = counts.limit(limit + 1).count() > limit
    if many:
        ranges = 2 * math.ceil(counts.count() / limit)
        dealt = counts.repartitionByRange(ranges, *keys, value).withColumn("_range", F.spark_partition_id())
        counts = stage(dealt, "value-ranges")
        keys = [*keys, "_range"]
    by = Window.partitionBy(*keys)
    upto = by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("n").over(upto)).withColumn("_total", F.sum("n").over(by))
    return _joined_ranges(ranked, counts, keys[:-1]) if many else ranked


def _joined_ranges(ranked: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts within ranges turned into those within keys."""
    by = Window.partitionBy(*keys)
    before = by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        counts.groupBy(*keys, "_range")
        .agg(F.sum("n").alias("_in_range"))
        .withColumn("_before", F.coalesce(F.sum("_in_range").over(before), F.lit(0)))
        .withColumn("_whole", F.sum("_in_range").over(by))
        .where(F.col("_whole") != F.col("_in_range"))
        .select(F.struct(F.lit(0), *keys).alias("_key"), F.col("_range").alias("_at"), "_before", "_whole")
    )
    same = (F.col("_range") == F.col("_at")) & F.struct(F.lit(0), *keys).eqNullSafe(F.col("_key"))
    return (
        ranked.join(F.broadcast(spread), same, "left")
        .withColumn("_upto", F.col("_upto") + F.coalesce("_before", F.lit(0)))
        .withColumn("_total", F.coalesce("_whole", "_total"))
        .drop("_key", "_at", "_before", "_whole", "_range")
    )


def quantiles_from_counts(
    counts: DataFrame, keys: list[str], value: str, probs: dict[str, float], *extra: Column, limit: int = RANGE_ROWS
) -> DataFrame:
    """Linearly interpolated quantiles per key from (keys, value, n).

    A key's values beyond ``limit`` are counted by ranges (``running_counts``); what follows is a
    grouping with partial results in the tasks, so no task takes a whole large key.
    """
    ranked = running_counts(counts, keys, value, limit)
    v = F.col(value).cast("double")
    aggs, parts = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        aggs += [
            F.min(F.when(F.col("_upto") > F.floor(pos), v)).alias(f"_lo_{name}"),
            F.min(F.when(F.col("_upto") > F.ceil(pos), v)).alias(f"_hi_{name}"),
        ]
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        parts.append((lo * (1 - frac) + hi * frac).alias(name))
    grouped = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs, *extra)
    extras = [c for c in grouped.columns if not c.startswith("_") and c not in keys]
    return grouped.select(*keys, *extras, *parts)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    return quantiles_from_counts(value_counts(df, keys, value), keys, value, probs)


def weighted_mean(value: str) -> Column:
    """Mean of a value column over (value, n) rows."""
    return F.sum(F.col(value) * F.col("n")) / F.sum("n")


def percent_rank_table(df: DataFrame, keys: list[str], value: str, limit: int = RANGE_ROWS) -> DataFrame:
    """(keys, value, n, percent_rank): SQL PERCENT_RANK worked out once per distinct value."""
    rank = F.when(F.col("_total") > 1, (F.col("_upto") - F.col("n")) / (F.col("_total") - 1)).otherwise(0.0)
    ranked = running_counts(value_counts(df, keys, value), keys, value, limit)
    return ranked.withColumn("percent_rank", rank).drop("_upto", "_total")


def with_percent_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return attach(df, percent_rank_table(df, keys, value), [*keys, value], weight="n")


def histogram(
    df: DataFrame, value: str, bins: int, by: str | None = None, groups: list | None = None
) -> DataFrame:
    """Equal-width bins ``[low, next low)`` over [min, max], the last one closed; empty bins
    are kept.

    ``by`` splits the counts by a column (one full set of bins for each of ``groups``) on
    shared bounds. A single distinct value gets the range value +- 0.5.
    """
    x = F.col(value).cast("double")
    src = df.where(x.isNotNull())
    lo, hi = F.min(x), F.max(x)
    bounds = src.agg(
        F.struct(
            F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
            F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
        ).alias("b")
    ).scalar()
    keys = [by] if by else []
    low = F.col("_b.lo")
    width = (F.col("_b.hi") - low) / F.lit(bins)
    guess = F.least(F.floor((F.col("_x") - low) / width), F.lit(bins - 1))
    # Division may land a value one bin beside its edges; the edges decide.
    settled = (
        F.when(F.col("_x") < low + width * F.col("_i"), F.col("_i") - 1)
        .when(
            (F.col("_i") < bins - 1) & (F.col("_x") >= low + width * (F.col("_i") + 1)),
            F.col("_i") + 1,
        )
        .otherwise(F.col("_i"))
    )
    counted = (
        src.select(*keys, x.alias("_x"), bounds.alias("_b"))
        .withColumn("_i", guess)
        .select(*keys, (settled + 1).alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = df.sparkSession.range(1, bins + 1, 1, 1).select(F.col("id").alias("bin"))
    if by:
        # The groups are the few the caller named, so the grid is bins x len(groups) rows.
        grid = grid.select(F.explode(F.array(*[F.lit(g) for g in groups])).alias(by), "bin")
    return (
        grid.withColumn("_b", bounds)
        .join(counted, [*keys, "bin"], "left")
        .select(
            *keys,
            "bin",
            (low + width * (F.col("bin") - 1)).alias("bin_low"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


@dataclass
class _Point:
    """A value of a slice: how many of its values are smaller, how many not larger, and those next to it."""

    value: float
    smaller: int
    upto: int
    before: float | None
    after: float | None


@dataclass
class _Slice:
    """Values between two bounds of a column, known to hold the ranks around one quantile."""

    column: str
    name: str
    rank: float
    size: int
    skipped: int = 0
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def value(self) -> Column:
        x = F.col(self.column).cast("double")
        inside = x.isNotNull()
        if self.low is not None:
            inside &= x > F.lit(self.low)
        if self.high is not None:
            inside &= x < F.lit(self.high)
        return F.when(inside, x)

    def cut(self, points: list[_Point]) -> None:
        """Shrink to the part around the ranks. A value that holds a rank settles the quantile, so
        the copies of one value never keep a slice large; any other value leaves the slice."""
        first, last = math.floor(self.rank) - self.skipped, math.ceil(self.rank) - self.skipped
        part = self.rank - math.floor(self.rank)
        start, end = 0, self.size
        for p in points:
            if p.smaller <= first < p.upto or p.smaller <= last < p.upto:
                lo = p.value if first >= p.smaller else p.before
                hi = p.value if last < p.upto else p.after
                self.found = lo * (1 - part) + hi * part
                return
            if p.upto <= first and p.upto > start:
                start, self.low = p.upto, p.value
            if p.smaller > last and p.smaller < end:
                end, self.high = p.smaller, p.value
        self.size, self.skipped = end - start, self.skipped + start


def _narrow(df: DataFrame, slices: list[_Slice], limit: int, k: int) -> None:
    """Shrink each slice until it holds at most ``limit`` rows or its quantile is settled.

    A round sketches the slices, takes a point at the wanted rank and one on each side, and counts the
    rows around each point. Sketches merge in two levels, so no task receives one from every input
    split. A poor sketch costs a round, never the result.
    """
    active = [s for s in slices if s.size > limit]
    while active:
        names = [f"s{i}" for i in range(len(active))]
        sketches = (
            df.select(
                (F.spark_partition_id() % 256).alias("_g"),
                *[s.value().alias(n) for s, n in zip(active, names)],
            )
            .groupBy("_g")
            .agg(*[F.kll_sketch_agg_double(n, F.lit(k)).alias(n) for n in names])
            .agg(*[F.kll_merge_agg_double(n).alias(n) for n in names])
        )
        sides = []
        for s, n in zip(active, names):
            at = (s.rank - s.skipped) / s.size
            near = [min(max(at + d, 0.0), 1.0) for d in (-8.0 / k, 0.0, 8.0 / k)]
            sides.append(
                F.array(*[F.kll_sketch_get_quantile_double(n, F.lit(p)) for p in near]).alias(n)
            )
        points = sketches.select(*sides).first()
        around = []
        for s, n in zip(active, names):
            x = s.value()
            for j, v in enumerate(points[n]):
                around += [
                    F.count_if(x < F.lit(v)).alias(f"{n}_{j}_smaller"),
                    F.count_if(x <= F.lit(v)).alias(f"{n}_{j}_upto"),
                    F.max(F.when(x < F.lit(v), x)).alias(f"{n}_{j}_before"),
                    F.min(F.when(x > F.lit(v), x)).alias(f"{n}_{j}_after"),
                ]
        counts = df.agg(*around).first()
        for s, n in zip(active, names):
            facts = ("smaller", "upto", "before", "after")
            s.cut([_Point(v, *[counts[f"{n}_{j}_{f}"] for f in facts]) for j, v in enumerate(points[n])])
        active = [s for s in active if s.found is None and s.size > limit]


def wide_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: dict[str, float],
    limit: int = 1_000_000,
    k: int = 2_000,
    extra: tuple = (),
) -> tuple[DataFrame, Row]:
    """Exact quantiles of columns of any kind, ids included, in a fixed number of passes.

    Columns with up to about ``limit`` distinct values are counted per value. For the
    others, slices around the wanted ranks are narrowed to ``limit`` rows first, and only
    rows in a slice are counted per value. The driver holds a few numbers per slice.

    Returns (column, quantile name, value) rows and the row of the first pass, which also
    holds the ``extra`` aggregates.
    """
    facts = df.agg(
        *extra,
        *[F.count(c).alias(f"n_{c}") for c in columns],
        *[F.approx_count_distinct(c).alias(f"d_{c}") for c in columns],
    ).first()
    filled = [c for c in columns if facts[f"n_{c}"]]
    few = [c for c in filled if facts[f"d_{c}"] <= limit]
    slices = [
        _Slice(c, name, p * (facts[f"n_{c}"] - 1), facts[f"n_{c}"])
        for c in filled
        if c not in few
        for name, p in probs.items()
    ]
    _narrow(df, slices, limit, k)
    settled = [(s.column, s.name, s.found) for s in slices if s.found is not None]
    slices = [s for s in slices if s.found is None]

    cells = [(c, "*", F.col(c).cast("double")) for c in few]
    cells += [(s.column, s.name, s.value()) for s in slices]
    wanted = [
        (c, "*", name, p * (facts[f"n_{c}"] - 1)) for c in few for name, p in probs.items()
    ] + [(s.column, s.name, s.name, s.rank - s.skipped) for s in slices]
    spark = df.sparkSession
    known = literal_table(spark, settled, "column string, q string, value double")
    if not wanted:
        return known, facts
    ranks = literal_table(spark, wanted, "column string, slice string, q string, rank double")
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(n).alias("slice"), v.alias("v")) for c, n, v in cells]
    )
    counted = (
        df.select(F.explode(entries).alias("e"))
        .select("e.*")
        .where(F.col("v").isNotNull())
        .groupBy("column", "slice", "v")
        .agg(row_count().alias("n"))
    )
    upto = F.sum("n").over(
        Window.partitionBy("column", "slice")
        .orderBy("v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    part = F.col("rank") - F.floor("rank")
    picked = (
        counted.withColumn("upto", upto)
        .join(F.broadcast(ranks), ["column", "slice"])  # one row per column and quantile
        .groupBy("column", "slice", "q", "rank")  # the window's partitioning serves
        .agg(
            F.min(F.when(F.col("upto") > F.floor("rank"), F.col("v"))).alias("lo"),
            F.min(F.when(F.col("upto") > F.ceil("rank"), F.col("v"))).alias("hi"),
        )
        .select("column", "q", (F.col("lo") * (1 - part) + F.col("hi") * part).alias("value"))
    )
    return (picked.union(known) if settled else picked), facts
