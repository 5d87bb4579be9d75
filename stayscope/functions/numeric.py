"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_count() -> Column:
    return F.count(F.lit(1))


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero, once, in decimal; returned as double.

    Going through the shortest decimal makes the result independent of how an engine rounds
    binary fractions such as 0.285. From 1e22 on (and for NaN) values stay as they are.
    """
    x = c.cast("double")
    return F.when(F.abs(x) < 1e22, F.round(x.cast("decimal(38,15)"), digits).cast("double")).otherwise(x)


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share of ``whole`` in percent; null when ``whole`` is 0."""
    return half_up(F.try_divide(part * F.lit(100.0), whole), digits)


def right_closed_bins(c: Column, edges: list, labels: list[str]) -> Column:
    """Label of the bin ``(lo, hi]`` holding the value; the first bin also takes its low edge.

    Values outside the outer edges give null. A last edge of None means no upper bound.
    """
    out = F.when(c < F.lit(edges[0]), None)
    for hi, label in zip(edges[1:], labels):
        out = out.when(c.isNotNull() if hi is None else c <= F.lit(hi), F.lit(label))
    return out


def hash_number(key: Column, seed: int) -> Column:
    """32 uniform bits from a key and a seed, the same in every run and partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    return (hash_number(key, seed) % F.lit(buckets)).cast("int")
