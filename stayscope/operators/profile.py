"""Profiling and validation: every report is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayscope.functions.numeric import half_up, pct, row_count
from stayscope.operators.distribution import value_counts, wide_quantiles
from stayscope.schema import ENGINEERED_FIELDS
from stayscope.sources.literal import literal_table


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _missing_counts(df: DataFrame) -> DataFrame:
    """One pass: (column_name, dtype, missing_count, rows), then one row per column."""
    wide = df.agg(
        row_count().alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(f"m{i}").alias("missing_count")
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return wide.select(F.explode(F.array(*cells)).alias("c"), "rows").select("c.*", "rows")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(row_count().alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values, the worst first."""
    return (
        _missing_counts(df)
        .where(F.col("missing_count") > 0)
        .select(
            "column_name",
            "missing_count",
            pct(F.col("missing_count"), F.col("rows"), 2).alias("missing_pct"),
        )
        .orderBy(F.desc("missing_pct"), "column_name")
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in full. Copies collapse before the shuffle."""
    copies = df.groupBy(*df.columns).agg(row_count().alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def numeric_summary(df: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max and nulls per numeric column.

    The plain figures ride along with a counting pass of the quartiles; they are one row
    for the whole table.
    """
    names = _numeric(df)
    figures = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "null_count": lambda x: F.count_if(x.isNull()),
    }
    extra = tuple(
        fn(F.col(c).cast("double")).alias(f"{f}_{c}") for c in names for f, fn in figures.items()
    )
    quartiles, row = wide_quantiles(df, names, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, extra=extra)
    stats = literal_table(
        df.sparkSession,
        [(c, *[row[f"{f}_{c}"] for f in figures]) for c in names],
        "column_name string, count long, mean double, std double, min double, max double, null_count long",
    )
    wide = quartiles.groupBy(F.col("column").alias("column_name")).agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(q) for q in ("p25", "p50", "p75")]
    )
    # The figures are one row per column of the table.
    return wide.join(F.broadcast(stats), "column_name", "right").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max", "null_count"
    )


def categorical_summary(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Distinct values and the most frequent ones per text column, share of all rows."""
    names = _text(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in names])
    counts = value_counts(df.select(F.explode(cells).alias("c")).select("c.*"), ["column_name"], "value")
    distinct = counts.groupBy("column_name").agg(F.count("value").alias("distinct_values"))
    ranked = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    total = df.agg(row_count().alias("n")).scalar()
    return (
        counts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= top_n)
        .join(distinct, "column_name")
        .withColumn("_rows", total)
        .select(
            "column_name",
            "distinct_values",
            "rank",
            "value",
            F.col("n").alias("count"),
            pct(F.col("n"), F.col("_rows")).alias("pct"),
        )
        .orderBy("column_name", "rank")
    )


def price_profile(df: DataFrame) -> DataFrame:
    """Range, mean, median, zeros and negatives of the price; text prices are flagged."""
    name = next((c for c in ("price", "Price", "PRICE") if c in df.columns), None)
    if name is None:
        raise ValueError("no price column")
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        sample = df.where(F.col(name).isNotNull()).select(F.first(name).alias("s")).scalar()
        return df.sparkSession.range(1).select(
            F.lit(name).alias("price_column"),
            F.lit(kind.simpleString()).alias("dtype"),
            sample.alias("sample_value"),
            F.lit(True).alias("needs_parsing"),
        )
    x = F.col(name).cast("double")
    median, row = wide_quantiles(
        df,
        [name],
        {"median": 0.5},
        extra=(
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            half_up(F.avg(x), 2).alias("mean"),
            F.count_if(x == 0).alias("zero_values"),
            F.count_if(x < 0).alias("negative_values"),
        ),
    )
    facts = ("min", "max", "mean", "zero_values", "negative_values")
    found = literal_table(
        df.sparkSession,
        [(name, kind.simpleString(), *[row[f] for f in facts])],
        "price_column string, dtype string, min double, max double, mean double, "
        "zero_values long, negative_values long",
    )
    return found.withColumn("median", median.agg(F.max("value")).scalar())


def schema_report(df: DataFrame) -> DataFrame:
    """Name, type and missing values of every column, with the table's shape."""
    return _missing_counts(df).select(
        "column_name",
        "dtype",
        "missing_count",
        pct(F.col("missing_count"), F.col("rows"), 2).alias("missing_pct"),
        F.col("rows").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
    )


def profile_all(df: DataFrame) -> dict[str, DataFrame]:
    """All reports of one table."""
    return {
        "shape": shape(df),
        "missing": missing(df),
        "duplicates": duplicates(df),
        "numeric": numeric_summary(df),
        "categorical": categorical_summary(df),
        "price": price_profile(df),
        "schema": schema_report(df),
    }


def as_long(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of different shapes as one table of (section, JSON row)."""
    parts = [
        d.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))
        for name, d in reports.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validate_cleaned(df: DataFrame) -> DataFrame:
    """One row of checks on a cleaned table.

    The two value lists come from columns of a few distinct values; they are built from
    per-value counts, not from rows.
    """

    def listed(c: str) -> Column:
        values = df.groupBy(c).agg(row_count().alias("n")).where(F.col(c).isNotNull())
        return values.agg(F.array_join(F.sort_array(F.collect_list(c)), "|")).scalar()

    nulls = F.array_join(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.count_if(F.col(c).isNull()) > 0,
                        F.concat(F.lit(f"{c}="), F.count_if(F.col(c).isNull()).cast("string")),
                    )
                    for c in df.columns
                ]
            )
        ),
        "|",
    )
    return (
        df.agg(
            row_count().alias("n_rows"),
            F.lit(len(df.columns)).alias("n_columns"),
            nulls.alias("remaining_nulls"),
            F.min("price").alias("price_min"),
            F.max("price").alias("price_max"),
            half_up(F.avg("price"), 2).alias("price_mean"),
            F.max("minimum_nights").alias("minimum_nights_max"),
        )
        .withColumn("room_types", listed("room_type"))
        .withColumn("boroughs", listed("neighbourhood_group"))
    )


def feature_summary(df: DataFrame) -> DataFrame:
    """Mean, min and max of numeric features; value counts of the category features."""
    kinds = {n: t for n, t in ENGINEERED_FIELDS if n in df.columns}
    numeric = [n for n, t in kinds.items() if isinstance(t, T.NumericType)]
    text = [n for n in kinds if n not in numeric]
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            half_up(F.avg(c), 2).alias("mean"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in numeric
    ]
    stats = (
        df.agg(F.array(*cells).alias("a"))
        .select(F.explode("a").alias("s"))
        .select(
            "s.feature",
            F.lit(None).cast("string").alias("value"),
            F.lit(None).cast("long").alias("count"),
            "s.mean",
            "s.min",
            "s.max",
        )
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in text])
    nothing = F.lit(None).cast("double")
    counted = (
        value_counts(df.select(F.explode(pairs).alias("p")).select("p.*"), ["feature"], "value")
        .withColumnRenamed("n", "count")
        .select(
            "feature",
            "value",
            "count",
            nothing.alias("mean"),
            nothing.alias("min"),
            nothing.alias("max"),
        )
    )
    return stats.unionByName(counted)
