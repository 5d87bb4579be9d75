"""Session settings. Cluster settings win; only local runs get small defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "stayscope", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings every operator assumes: AQE, skew handling, UTC.

    ``master`` is only for local runs; on a cluster the submit command names it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        threads = master[master.find("[") + 1 : -1] if "[" in master else "8"
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", threads if threads.isdigit() else "8")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
