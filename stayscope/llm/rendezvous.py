"""Sharding by rendezvous hashing: every key meets every shard in a hash, the best shard wins.

A key's shard depends on the key and the weighted shards alone. A new shard takes over just the
keys that it wins; a removed one gives just its own away. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayscope.sources.staging import stage


def _score(key: list[Column], shard: int, weight: float) -> Column:
    """Exponential variate of rate ``weight`` from the hash of key and shard; the smallest wins."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard).cast("int")), 11)
    return -F.log((bits + F.lit(0.5)) * F.lit(2.0**-53)) / F.lit(float(weight))


def rendezvous_shard(key: list[Column], weights: Mapping[int, float]) -> Column:
    """Shard number of a key; equal scores go to the smaller number; a null key has one shard."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("every shard needs a weight above 0")
    scored = [
        F.struct(_score(key, s, w).alias("score"), F.lit(s).cast("int").alias("shard"))
        for s, w in sorted(weights.items())
    ]
    best = scored[0] if len(scored) == 1 else F.least(*scored)
    return best["shard"]


def number_rows(
    rows: DataFrame, group: str, order: list[str], name: str = "slot", rows_per_piece: int = 4096
) -> DataFrame:
    """Add gapless numbers from 0 within each group without bringing a group into one task.

    The table is written once with a piece number per row (from its order columns and the task that
    wrote it, so even repeats of one key are spread). Counts of pieces give their starts. Groups, never null,
    hold about ``rows_per_piece`` rows a piece at every size.
    """
    made = [F.xxhash64(*order, F.spark_partition_id()).alias("__spread")]
    kept = stage(rows.select("*", *made), "shards")
    groups = kept.agg(F.count("*").alias("n"), F.approx_count_distinct(group).alias("g"))
    pieces = groups.select(F.greatest(F.lit(1), F.ceil(F.col("n") / (F.greatest("g", F.lit(1)) * rows_per_piece))))
    cut = kept.withColumn("__piece", F.pmod(F.col("__spread"), pieces.scalar()).cast("long"))
    starts = (
        cut.groupBy(group, "__piece")
        .agg(F.count("*").alias("__n"))
        .withColumn(
            "__start",
            F.coalesce(
                F.sum("__n").over(
                    Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select(F.col(group).alias("__group"), F.col("__piece").alias("__of"), "__start")
    )
    inside = Window.partitionBy(group, "__piece").orderBy(*order, "__spread")
    numbered = cut.withColumn("__row", F.row_number().over(inside) - 1)
    joined = numbered.join(
        starts, (F.col(group) == F.col("__group")) & (F.col("__piece") == F.col("__of"))
    )
    return joined.withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop(
        "__spread", "__piece", "__row", "__group", "__of", "__start"
    )


def assign_shards(
    docs: DataFrame,
    shards: Mapping[int, float] | int = 16,
    key: str = "doc_id",
    text: str = "text",
    grown: Mapping[int, float] | int | None = None,
    rows_per_piece: int = 4096,
) -> DataFrame:
    """Shard of every row by its key: key, size, text_crc32, shard, grown_shard, slot.

    ``shards``: weights by shard number, or a count of equal shards. ``grown``: the shards of a
    later set-up, by default one more of weight 1. ``slot`` numbers the rows of a shard from 0.

    Null keys share one shard; repeated rows keep their own slots in the same shard; a null text
    counts as empty. Other columns are not read. An empty table gives an empty table.
    """
    now = dict.fromkeys(range(shards), 1.0) if isinstance(shards, int) else dict(shards)
    later = {**now, max(now) + 1: 1.0} if grown is None else grown
    later = dict.fromkeys(range(later), 1.0) if isinstance(later, int) else dict(later)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).cast("long").alias("text_crc32"),
        rendezvous_shard([F.col(key)], now).alias("shard"),
        rendezvous_shard([F.col(key)], later).alias("grown_shard"),
    )
    done = number_rows(rows, "shard", ["doc_id", "text_crc32"], "slot", rows_per_piece)
    return done.withColumnRenamed("doc_id", key)


def shard_balance(assigned: DataFrame) -> DataFrame:
    """Rows and bytes of every shard."""
    return assigned.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
