"""WARC archives compressed record by record with a dictionary of their own.

Each file begins with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary trained
on the file's first records; every record is then one Zstandard frame. Pages with equal payloads are
stored once: the one with the largest id is the response, the others are revisits of it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.sources.staging import new_path, stage

from .files import qualified, reading, writing

DICTIONARY_FRAME = 0x184D2A5D
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _id(name: str) -> int | None:
    inside = name.removeprefix("<urn:page:").removesuffix(">")
    return None if inside == "none" else int(inside)


def make_record(page, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head alone, which still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(page),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        # Line breaks can't stand in a header.
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _name(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {
        "fields": fields,
        "http": dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]),
        "payload": payload,
    }


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; of few or odd samples their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    # Without enough bytes there is no dictionary; with its magic number in front it is a trained one.
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


class ArchiveWriter:
    """Collects the first records, trains the dictionary, then writes record by record."""

    def __init__(self, stream, dictionary_bytes: int, sample_bytes: int, level: int):
        self._stream, self._size, self._sample_bytes, self._level = stream, dictionary_bytes, sample_bytes, level
        self._samples: list[bytes] | None = []
        self._sampled, self.n_records, self.n_bytes = 0, 0, 0

    def add(self, record: bytes) -> None:
        self.n_records += 1
        if self._samples is None:
            self._put(self._zip.compress(record))
            return
        self._samples.append(record)
        self._sampled += len(record)
        if self._sampled >= self._sample_bytes:
            self._begin()

    def _begin(self) -> None:
        # A sample is a record's beginning: one very long record must not be the whole sample.
        data = train_dictionary([s[:32_768] for s in self._samples], self._size)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        words = _dictionary(data)
        self._zip = zstandard.ZstdCompressor(level=self._level, **({"dict_data": words} if words else {}))
        held, self._samples = self._samples, None
        for record in held:
            self._put(self._zip.compress(record))

    def _put(self, data: bytes) -> None:
        self._stream.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        if self._samples is not None:
            self._begin()


def read_archive(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """Records of an archive, one after another, with one record in memory at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive has no leading dictionary")
    words = _dictionary(stream.read(size))
    unzip = zstandard.ZstdDecompressor(**({"dict_data": words} if words else {}))
    data = b""
    while True:
        frame, out = unzip.decompressobj(), []
        while not frame.eof:
            if not data:
                data = stream.read(piece)
                if not data:
                    if out:
                        raise ValueError("the archive ends within a record")
                    return
            out.append(frame.decompress(data))
            data = frame.unused_data
        yield b"".join(out)


def mark_revisits(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 1000
) -> DataFrame:
    """Rows as page_id, url, payload, digest and refers_to (null for responses).

    Payloads of at least ``least`` bytes are grouped by SHA-1 and length. Groups are counted in the
    tasks first, and only groups of several rows are joined back, so a group of any size is a row per
    task. A row whose id is the group's largest is a response, also when such rows repeat; rows with
    null ids in a group with other ids are revisits.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    groups = (
        rows.where(large)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("last").isNotNull())
        .select("of", "last")
    )
    found = rows.join(groups, large & (F.col("digest") == F.col("of")), "left")
    return found.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"),
    )


_FILES = "path string, n_records long, n_bytes long"


def write_archives(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    folder: str | None = None,
    least: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    dictionary_bytes: int = 65_536,
    sample_bytes: int = 4_000_000,
    bytes_per_file: int = 256_000_000,
    level: int = 3,
) -> DataFrame:
    """Write a record per row; returns the list of files: path, n_records, n_bytes.

    Null payloads are empty. An empty table writes no file. ``sample_bytes`` bounds what a dictionary
    is trained on; all rows are written. Other columns are not read.
    """
    folder = qualified(pages.sparkSession, folder or new_path(pages.sparkSession, "warc"))
    columns = "page_id", "url", "payload", "digest", "refers_to"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns)) for b in batches)
        row = next(rows, None)
        while row is not None:
            with writing(folder, ".warc.zst") as (path, stream):
                out = ArchiveWriter(stream, dictionary_bytes, sample_bytes, level)
                while row is not None and out.n_bytes < bytes_per_file:
                    page, at, body, digest, refers_to = row
                    out.add(make_record(page, at, body, digest, refers_to, refers_to is not None, date))
                    row = next(rows, None)
                out.close()
            found = [pa.array([path]), pa.array([out.n_records], pa.int64()), pa.array([out.n_bytes], pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["path", "n_records", "n_bytes"])

    marked = mark_revisits(pages, key, url, payload, least)
    return stage(marked.mapInArrow(write, _FILES), "warc-files")


def read_archives(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of the listed archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    A response's length and digest are those of the payload that was read, and must equal its
    header; a revisit's are from its headers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with reading(path) as stream:
                    held, size = [], 0
                    for data in read_archive(stream):
                        held.append(_row(parse_record(data)))
                        size += len(data)
                        if size >= 16_000_000 or len(held) >= 4096:
                            yield _batch(held, with_payload)
                            held, size = [], 0
                    if held:
                        yield _batch(held, with_payload)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    # A count given outright: small lists would be joined into a single task otherwise.
    listed = files.select("path").repartition(max(files.count(), 1))
    return listed.mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def _row(record: dict) -> dict:
    fields, payload = record["fields"], record["payload"]
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    n = int(record["http"]["Content-Length"])
    if not revisit and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is not what its header says")
    return {
        "page_id": _id(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": _id(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


_TYPES = {
    "page_id": pa.int64(),
    "url": pa.string(),
    "record_type": pa.string(),
    "payload_bytes": pa.int64(),
    "payload_digest": pa.string(),
    "refers_to": pa.int64(),
    "payload": pa.binary(),
}


def _batch(rows: list[dict], with_payload: bool) -> pa.RecordBatch:
    names = [n for n in _TYPES if with_payload or n != "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES[n]) for n in names], names)
