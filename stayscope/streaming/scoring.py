"""Validation and scoring of a stream of request files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stayscope.operators.score import score, validate_requests
from stayscope.schema import BOROUGHS, REQUEST_SCHEMA, ROOM_TYPES


def read_requests(
    spark: SparkSession, folder: str, fmt: str = "parquet", files_per_trigger: int = 1_000
) -> DataFrame:
    """Stream of new request files; each micro-batch takes a bounded number of them."""
    return (
        spark.readStream.schema(REQUEST_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(folder)
    )


def start_scoring(
    requests: DataFrame,
    medians: tuple[DataFrame, DataFrame],
    predict: Callable[[DataFrame], DataFrame],
    out: str,
    rejected_out: str,
    checkpoint: str,
    boroughs: list[str] = BOROUGHS,
    room_types: list[str] = ROOM_TYPES,
    available_now: bool = True,
    **score_options,
) -> StreamingQuery:
    """One query, one read of the source: responses of valid requests, and rejected requests.

    Every micro-batch is written under its number, over what an earlier attempt at the same batch
    left, so a repeated batch changes neither output. ``read_written`` reads them. The saved median
    tables are joined as static tables.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            valid, rejected = validate_requests(batch, boroughs, room_types)
            for df, path in ((score(valid, medians, predict, **score_options), out), (rejected, rejected_out)):
                df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an output of ``start_scoring``."""
    return spark.read.parquet(path).drop("batch")
