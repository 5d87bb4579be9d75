"""Written tables between steps: they cut lineage, give later plans real sizes and survive
lost executors, since they live in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master."""
    root = spark.conf.get(_SETTING, None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="stayscope-")
        spark.conf.set(_SETTING, root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/stayscope/{app}/{label}-{uuid.uuid4().hex[:12]}"


#: Shuffle files of a written step aren't read again; without this they stay until the driver's
#: garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The setting belongs to the session, so threads write one after another.
_WRITING = threading.Lock()


def stage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    return _staged(df, new_path(df.sparkSession, label))


def _staged(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _WRITING:
        before = spark.conf.get(_CLEANUP, "false")
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Steps that one operator writes for itself; they are removed when it is done.

    ``with Scratch(spark) as scratch: scratch.stage(df)``. What the operator returns must be staged
    by ``stage`` instead, or be computed before the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._folder = spark, new_path(spark, "scratch")

    def stage(self, df: DataFrame, label: str = "step") -> DataFrame:
        return _staged(df, f"{self._folder}/{label}-{uuid.uuid4().hex[:12]}")

    def path(self, label: str) -> str:
        """A folder for other files of the operator."""
        return f"{self._folder}/{label}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self._folder)
