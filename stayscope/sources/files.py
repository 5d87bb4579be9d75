"""Binary files that tasks write and read in the shared folder, through Arrow's file systems."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession

#: Schemes of Hadoop's connectors that Arrow calls otherwise.
_ARROW_NAMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}
_SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs", "abfs")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the store it lies in.

    A folder without a scheme belongs to the cluster's default store; only the driver's settings name
    that, so this is settled before tasks open files.
    """
    if ":" not in folder.split("/")[0]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _place(folder, find=False)
    return folder


def _place(path: str, find: bool = True):
    scheme, colon, rest = path.partition(":")
    scheme = _ARROW_NAMES.get(scheme, scheme)
    if not colon or scheme not in _SCHEMES:
        raise ValueError(f"{path}: name one of the stores {', '.join(_SCHEMES)}")
    return fs.FileSystem.from_uri(f"{scheme}:{rest}") if find else None


@contextlib.contextmanager
def writing(folder: str, suffix: str) -> Iterator[tuple[str, object]]:
    """A new file under a name of its own: (path, stream). ``folder`` is qualified.

    A repeated or second attempt of a task writes another file. What counts is the list of paths
    that the finished attempts return, so a file of a lost attempt is never read.
    """
    store, base = _place(folder)
    store.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None) as stream:
        yield f"{folder.rstrip('/')}/{name}", stream


def reading(path: str):
    """A file for reading at any place."""
    store, at = _place(path)
    return store.open_input_file(at)


class Exchange:
    """Messages that tasks which run at the same time send to all others, through files of a shared folder.

    A file begins with its length, so one that is still written is not taken for whole. A task that has
    everybody's next message knows that all have read its last one, and deletes that.
    """

    def __init__(self, folder: str, me: int, tasks: int):
        (self._store, self._folder), self._me, self._tasks, self._step = _place(folder), me, tasks, 0
        self._store.create_dir(self._folder, recursive=True)

    def _path(self, step: int, task: int) -> str:
        return f"{self._folder}/{step}-{task}"

    def swap(self, own: bytes) -> list[bytes]:
        """The messages of all tasks in their order; every task calls this as often as the others."""
        with self._store.open_output_stream(self._path(self._step, self._me), compression=None) as out:
            out.write(len(own).to_bytes(8, "little") + own)
        found = [own if k == self._me else self._awaited(self._path(self._step, k)) for k in range(self._tasks)]
        if self._step:
            self._store.delete_file(self._path(self._step - 1, self._me))
        self._step += 1
        return found

    def _awaited(self, path: str) -> bytes:
        """A file's message once it is whole. Spark ends the tasks that wait if another one fails."""
        began = time.monotonic()
        while True:
            with contextlib.suppress(FileNotFoundError), self._store.open_input_file(path) as held:
                # The size is that at opening, so only what was there then is read.
                size = held.size()
                if size >= 8 and size == 8 + int.from_bytes(held.read(8), "little"):
                    return held.read(size - 8)
            # Short steps at first: what a task sleeps too long, all the others wait for.
            time.sleep(0.0005 if time.monotonic() - began < 2 else 0.02)
