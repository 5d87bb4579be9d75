"""Independent Spark jobs at the same time."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def side_by_side(spark: SparkSession, jobs: list[Callable]) -> list:
    """Results of the jobs in their order. Each is started by a thread of its own, so that a job of
    few tasks leaves the other cores to the rest; the first error ends the call."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(len(jobs)) as pool:
        return list(pool.imap(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))
