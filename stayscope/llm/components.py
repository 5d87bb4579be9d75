"""Connected components of links by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.sources.staging import Scratch, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003))).alias("mark")
    ).first()
    return row["n"], row["mark"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the smallest node that it reaches) of every node that has a link.

    In a round every node's larger neighbours move to its smallest one, then its smaller neighbours
    do; rounds are few, as paths shrink by a factor. Edges stay no more than they were. Links of a
    node with itself and repeated links change nothing.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.stage(edges, "links")
        before = _state(edges)
        while True:
            edges = scratch.stage(_small_star(scratch.stage(_large_star(edges), "large")), "small")
            now = _state(edges)
            if now == before:
                break
            before = now
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return stage(roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    lowest = both.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    moved = both.join(lowest, F.col("u") == F.col("of")).where(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    joined = edges.join(lowest, F.col("u") == F.col("of"))
    others = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select("u", F.col("m").alias("v")).union(others).distinct()
