"""Table, file and JDBC sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITE_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def save_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    if_exists: str = "replace",
    partition_by: tuple[str, ...] = (),
) -> str:
    """Write a table to ``path``. CSV keeps the header and the blanks inside fields."""
    writer = df.write.mode(WRITE_MODES[if_exists]).format(fmt)
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def jdbc_options(url: str, table: str, batch_size: int = 500, partitions: int = 8, **extra) -> dict:
    """Options of a JDBC write; ``partitions`` bounds the open connections."""
    return {
        "url": url,
        "dbtable": table,
        "batchsize": str(batch_size),
        "numPartitions": str(partitions),
        **extra,
    }


def write_jdbc(df: DataFrame, url: str, table: str, if_exists: str = "replace", **options) -> None:
    """Load a table into a database, in batches of 500 rows by default."""
    mode = WRITE_MODES[if_exists]
    df.write.format("jdbc").options(**jdbc_options(url, table, **options)).mode(mode).save()


def verify_load(spark: SparkSession, path: str, source: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Row counts of a written table and of its source."""
    written = spark.read.format(fmt)
    if fmt == "csv":
        written = written.option("header", True).option("multiLine", True).option("escape", '"')
    counted = written.load(path).agg(F.count(F.lit(1)).alias("table_rows"))
    expected = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counted.withColumn("source_rows", expected).withColumn(
        "matches", F.col("table_rows") == F.col("source_rows")
    )
