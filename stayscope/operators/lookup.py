"""Attaching one-row-per-key tables to big tables without trusting key or size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.sources.staging import stage

BROADCAST_ROWS = 50_000
HOT_KEYS = 1_000
SPREAD = 16


def _dealt(others: list[str], keys: list[str], spread: int):
    """A number below ``spread`` that differs between rows of one key."""
    return F.pmod(F.xxhash64(F.spark_partition_id(), *others, *keys), F.lit(spread)).cast("int")


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    weight: str,
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_keys: int = HOT_KEYS,
    staged: bool = False,
    spread: int = SPREAD,
) -> DataFrame:
    """Join ``table`` (unique on ``keys``; ``weight`` = rows of the key) to ``rows``.

    ``table`` is written first unless it is ``staged``, so its size is known, not guessed.
    Up to ``broadcast_rows`` rows it is broadcast and ``rows`` never moves. Beyond that the
    ``hot_keys`` heaviest keys are broadcast; each other key holds less than 1/``hot_keys``
    of the rows and goes through a shuffled join. Rows already served, or without a key,
    pass that join spread by their input partition instead of by key. Keys that the table lacks
    can be as frequent as they like and can't be counted ahead in a stream, so all other rows are
    dealt over ``spread`` copies of the remaining table. A table that holds every key of ``rows``, with its
    true weight, needs one copy only: ``spread=1``. ``rows`` is read once.
    """
    if not staged:
        table = stage(table, "lookup")
    slim = table.drop(weight)
    if table.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(slim), keys, how)

    values = [c for c in slim.columns if c not in keys]
    others = [c for c in rows.columns if c not in keys]
    hot = table.orderBy(F.desc(weight), *keys).limit(hot_keys).select(
        *keys, F.struct(*values).alias("_hot")
    )
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    cold = table.select(*keys, copies.alias("_spread"), F.struct(*values).alias("_cold"))
    done = F.col("_hot").isNotNull()
    for k in keys:
        done |= F.col(k).isNull()
    joined = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_spread", F.when(done, -F.spark_partition_id() - 1).otherwise(_dealt(others, keys, spread)))
        .join(cold, [*keys, "_spread"], "left")
        .withColumn("_found", F.coalesce("_hot", "_cold"))
    )
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    return joined.select(*keys, *others, *[F.col(f"_found.{v}").alias(v) for v in values])
