"""Listing readers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayscope.functions.text import null_tokens_to_null
from stayscope.schema import (
    CATEGORICAL_FEATURES,
    FEATURED_SCHEMA,
    NUMERIC_FEATURES,
    RAW_SCHEMA,
    TARGET,
)


def _read_text_columns(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """CSV with every column as text, named by the header; no inference pass over the data."""
    try:
        return (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no listing data at {path}") from e
        raise


#: Columns that may hold fractions in a file, whatever they hold in a table made elsewhere.
FRACTIONAL = ("price", "minimum_nights")
UNREAD = "_unread"


def _typed(df: DataFrame, schema: T.StructType, unread: str | None = None) -> DataFrame:
    """Null tokens to null, then the known columns to their types; other columns stay text.

    Whole-number columns take a decimal text only if its fraction is 0. ``unread`` names a column
    for the names of those columns whose text could not be read.
    """
    types = {f.name: T.DoubleType() if f.name in FRACTIONAL else f.dataType for f in schema}
    columns, failed = [], []
    for name in df.columns:
        text, t = null_tokens_to_null(F.col(f"`{name}`")), types.get(name)
        value = text
        if isinstance(t, T.IntegralType):
            number = text.try_cast("double")
            value = F.coalesce(text.try_cast(t), F.when(number == F.floor(number), number.try_cast(t)))
        elif t is not None and not isinstance(t, T.StringType):
            value = text.try_cast(t)
        if value is not text:
            failed.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
        columns.append(value.alias(name))
    if unread:
        columns.append(F.array_compact(F.array(*failed)).cast("array<string>").alias(unread))
    return df.select(columns)


def unread_counts(listings: DataFrame, unread: str = UNREAD) -> DataFrame:
    """Cells that could not be read, per column that has any."""
    names = listings.select(F.explode(unread).alias("column_name"))
    return names.groupBy("column_name").agg(F.count("*").alias("n"))


def load_listings(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False, unread: str | None = UNREAD
) -> DataFrame:
    """Raw listings. From CSV the column ``unread`` tells which cells could not be read.

    Quoted line breaks need ``multi_line``, which makes every file one task; without it Spark
    splits single files among tasks."""
    if fmt == "csv":
        return _typed(_read_text_columns(spark, path, multi_line), RAW_SCHEMA, unread)
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no listing data at {path}") from e
        raise


def load_featured(
    spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False
) -> DataFrame:
    """The featured table; from CSV the types come back, an unreadable date becomes null."""
    if fmt == "csv":
        return _typed(_read_text_columns(spark, path, multi_line), FEATURED_SCHEMA)
    return load_listings(spark, path, fmt)


def load_cached(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Featured table kept by the executors; what does not fit in memory goes to disk."""
    return load_featured(spark, path, fmt).persist(StorageLevel.MEMORY_AND_DISK)


def select_ml_columns(featured: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 16 features and the target, rows with any of them missing dropped."""
    needed = CATEGORICAL_FEATURES + NUMERIC_FEATURES + [TARGET]
    return featured.select(*keep, *needed).dropna("any", subset=needed)
