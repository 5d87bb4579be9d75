"""Token-ID files of bit-plane-shuffled blocks.

A file is a run of blocks of a fixed number of ids (the last one may be shorter). A block is turned
into planes: all lowest bytes, all second bytes and so on, or the same by bits. Every plane is
compressed with zstandard by itself; planes of zeros take a few bytes. Behind the blocks come the
documents (key and number of ids, in order, as a compressed Arrow stream), the chunk index and its
length.

    magic | planes of block 0 | planes of block 1 | ... | documents | index (JSON) | length (8) | magic
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tokenizers import Regex, Tokenizer, normalizers

from stayscope.sources.staging import new_path, stage

from .files import qualified, reading, writing
from .remembered import remembered
from .splitting import FIRST_PLANE, ChunkedEncoder, Recent, every_character, keeps_words, splitter, written_out
from .text import few_rows

MAGIC = b"IDPLANE1"


def to_planes(ids: np.ndarray, by: str) -> list[bytes]:
    """Planes of 32-bit ids, lowest first."""
    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if by == "byte":
        return [table[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(table, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of ``n`` values from 4 byte planes or 32 bit planes."""
    table = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        bits = np.unpackbits(table, axis=1, count=n, bitorder="little").T
        table = np.packbits(bits, axis=1, bitorder="little").T
    return np.ascontiguousarray(table.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes blocks of ids to a stream as they fill; at most one block is held."""

    def __init__(self, stream, by: str = "byte", block_ids: int = 65_536, level: int = 3):
        if by not in ("bit", "byte"):
            raise ValueError("planes are by bit or byte")
        self._stream, self._by, self._block = stream, by, block_ids
        self._zip = zstandard.ZstdCompressor(level=level)
        self._waiting: list[bytes] = []
        self._n_waiting, self.n_ids, self._at = 0, 0, len(MAGIC)
        self._chunks: list[dict] = []
        stream.write(MAGIC)

    def add(self, ids: bytes) -> None:
        """Ids of one document, 32 bits each."""
        self._waiting.append(ids)
        self._n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self._n_waiting >= self._block:
            every = np.frombuffer(b"".join(self._waiting), "<u4")
            whole = len(every) // self._block * self._block
            for start in range(0, whole, self._block):
                self._put(every[start : start + self._block])
            self._waiting, self._n_waiting = [every[whole:].tobytes()], len(every) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self._zip.compress(p) for p in to_planes(ids, self._by)]
        for plane in planes:
            self._stream.write(plane)
        self._chunks.append({"at": self._at, "n": len(ids), "planes": [len(p) for p in planes]})
        self._at += sum(map(len, planes))

    def close(self, documents: pa.Table) -> int:
        """Write the rest, the documents (key, n) and the index; returns the file's bytes."""
        if self._n_waiting:
            self._put(np.frombuffer(b"".join(self._waiting), "<u4"))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, documents.schema) as out:
            out.write_table(documents)
        packed = self._zip.compress(sink.getvalue().to_pybytes())
        index = json.dumps({"documents": [self._at, len(packed)], "chunks": self._chunks}).encode()
        self._stream.write(packed + index + struct.pack("<Q", len(index)) + MAGIC)
        return self._at + len(packed) + len(index) + 8 + len(MAGIC)


class PlaneReader:
    """Reads documents of a file; blocks are read by the index as they are needed."""

    def __init__(self, stream):
        self._stream, self._unzip = stream, zstandard.ZstdDecompressor()
        size = stream.size()
        length, magic = struct.unpack("<Q8s", self._read(size - 16, 16))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        index = json.loads(self._read(size - 16 - length, length))
        self.chunks = index["chunks"]
        self.documents = pa.ipc.open_stream(self._unzip.decompress(self._read(*index["documents"]))).read_all()

    def _read(self, at: int, n: int) -> bytes:
        self._stream.seek(at)
        return self._stream.read(n)

    def block(self, number: int) -> np.ndarray:
        chunk = self.chunks[number]
        data, planes, at = self._read(chunk["at"], sum(chunk["planes"])), [], 0
        for size in chunk["planes"]:
            planes.append(self._unzip.decompress(data[at : at + size]))
            at += size
        return from_planes(planes, chunk["n"])

    def __iter__(self) -> Iterator[bytes]:
        """Ids of the documents in order."""
        number, held, at = 0, b"", 0
        for n in self.documents.column("n").to_pylist():
            parts, missing = [], 4 * n
            while missing:
                if at == len(held):
                    held, number, at = self.block(number).tobytes(), number + 1, 0
                parts.append(held[at : at + missing])
                at += len(parts[-1])
                missing -= len(parts[-1])
            yield b"".join(parts)


_FILE = "part int, number int, path string, n_documents long, n_ids long, n_bytes long"


def write_ids(
    docs: DataFrame,
    encoder,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = None,
    folder: str | None = None,
    by: str = "byte",
    ids_per_file: int = 32_000_000,
) -> DataFrame:
    """Encode and write all rows in ascending key order; returns the list of files.

    ``encoder()`` is called once per task and gives a function from a list of texts to a list of ids
    as bytes. Rows are dealt out by ranges of the key (and a hash of the text, so repeats of a key
    are spread), each task writes its range as files of about ``ids_per_file`` ids. The list has a
    row per file: part, number, path, n_documents, n_ids, n_bytes, start (ids in all files before).

    Null texts are empty; with ``end_id`` every document ends in that id. Null keys come first; equal
    keys stand side by side. An empty table writes no file. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or new_path(spark, "ids"))
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("spread", F.xxhash64("text"))
    dealt = rows.repartitionByRange("key", "spread").sortWithinPartitions("key", "spread")
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(), TaskContext.get().partitionId(), 0
        pending = (
            (few.column("key"), encode(few.column("text").to_pylist())) for few in few_rows(batches)
        )
        few, at = next(pending, None), 0
        while few is not None:
            with writing(folder, ".ids") as (path, stream):
                out, keys, sizes = PlaneWriter(stream, by), [], []
                while few is not None and (not sizes or out.n_ids < ids_per_file):
                    first = at
                    while at < len(few[1]) and (not sizes or out.n_ids < ids_per_file):
                        ids = few[1][at] + end
                        out.add(ids)
                        sizes.append(len(ids) // 4)
                        at += 1
                    keys.append(few[0].slice(first, at - first))
                    if at == len(few[1]):
                        few, at = next(pending, None), 0
                documents = pa.table({"key": pa.concat_arrays(keys), "n": pa.array(sizes, pa.int64())})
                n_bytes = out.close(documents)
            found = [part], [number], [path], [len(sizes)], [out.n_ids], [n_bytes]
            types = pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            names = "part", "number", "path", "n_documents", "n_ids", "n_bytes"
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, types)], list(names))
            number += 1

    files = stage(dealt.mapInArrow(write, _FILE), "id-files")
    # One row per file, each of many megabytes.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(files: DataFrame, key_field: StructField, tasks: int | None = None) -> DataFrame:
    """Documents of the listed files: key, start, n_tokens, ids (binary, 32 bits each)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with reading(path) as stream:
                    reader = PlaneReader(stream)
                    keys = reader.documents.column("key").combine_chunks()
                    sizes = np.asarray(reader.documents.column("n"))
                    starts = start + np.cumsum(sizes) - sizes
                    at, held, waiting = 0, 0, []
                    for ids in reader:
                        waiting.append(ids)
                        held += len(ids)
                        if held >= 4_000_000:
                            yield _documents(keys, sizes, starts, at, waiting)
                            at, held, waiting = at + len(waiting), 0, []
                    if waiting:
                        yield _documents(keys, sizes, starts, at, waiting)

    fields = [StructField("key", key_field.dataType), StructField("start", LongType()), StructField("n_tokens", LongType())]
    schema = StructType(fields).add("ids", "binary")
    listed = files.select("path", "start")
    # A count given outright: small lists would be joined into a single task otherwise.
    return listed.repartition(tasks or max(files.count(), 1)).mapInArrow(read, schema).withColumnRenamed("key", key_field.name)


def _documents(keys, sizes, starts, at: int, ids: list[bytes]) -> pa.RecordBatch:
    to = at + len(ids)
    columns = [keys.slice(at, len(ids)), pa.array(starts[at:to]), pa.array(sizes[at:to]), pa.array(ids, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "start", "n_tokens", "ids"])


def _class_members(name: str) -> str:
    """Characters of a regex class in the tokenizers library's edition of Unicode."""
    others = name.swapcase() if len(name) == 2 else name.replace(r"\p", r"\P")
    return normalizers.Replace(Regex(f"{others}+"), "").normalize_str(every_character())


def _byte_letters() -> dict[int, str]:
    """The character that byte-level definitions write for each byte: printable ones as they are,
    the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _added_tokens(definition: str):
    """Pattern of the added tokens' strings with the blanks they take in, and their ids; None without any."""
    tokens = sorted(json.loads(definition).get("added_tokens") or [], key=lambda t: -len(t["content"]))
    if not tokens:
        return None, {}
    parts = []
    for n, t in enumerate(tokens):
        word = r"(?<!\w)", r"(?!\w)"
        left, right = word if t.get("single_word") else ("", "")
        before, after = (r"\s*" if t.get(side) else "" for side in ("lstrip", "rstrip"))
        parts.append(f"{before}{left}(?P<t{n}>{re.escape(t['content'])}){right}{after}")
    return re.compile("|".join(parts)), {f"t{n}": t["id"].to_bytes(4, "little") for n, t in enumerate(tokens)}


def tokenizer_encoder(definition: str, pattern: str, cached: int = 450_000):
    """Encoder of a byte-level BPE definition (JSON) of the tokenizers library, for ``write_ids``.

    ``pattern`` is the one by which the definition's pre-tokenizer splits. The library's model
    encodes the pieces; ids of frequent words and pieces are remembered. Strings of the definition's
    added tokens become those tokens, as in the library; none is added besides.
    """
    parts = written_out(pattern, _class_members, FIRST_PLANE), written_out(pattern, _class_members)

    def make():
        model, split, letters = Tokenizer.from_str(definition).model, splitter(*parts), _byte_letters()

        def packed(found: list) -> bytes:
            return b"".join([bytes_of[t.id] for t in found])

        def piece(text: str) -> bytes:
            found = model.tokenize(text.encode().decode("latin-1").translate(letters))
            return packed(found)

        def word(text: str) -> bytes:
            return packed(model.tokenize(space + text))

        def marks(text: str) -> bytes | None:
            """Ids of marks behind a word of ASCII letters; None if the pattern doesn't split them off."""
            first, *found = split(" a" + text)
            return b"".join(map(ids, found)) if first == " a" else None

        def pieces(text: str) -> bytes:
            """Ids of a text; a lone piece and a word in front are remembered elsewhere."""
            found = split(text)
            if len(found) == 1:
                return piece(found[0])
            first = found[0][1:] if keeps and found and found[0][0] == " " else ""
            if first.isascii() and first.isalpha():
                return whole.after_space(first) + b"".join(map(ids, found[1:]))
            return b"".join(map(ids, found))

        space, keeps = letters[ord(" ")], keeps_words(split)
        vocabulary = json.loads(definition)["model"]["vocab"].values()
        bytes_of = {number: number.to_bytes(4, "little") for number in vocabulary}
        ids = Recent(piece, cached // 8).__getitem__
        whole = ChunkedEncoder(pieces, cached, *((word, marks) if keeps else ()))
        added, id_of = _added_tokens(definition)

        def encode(text: str) -> bytes:
            out, at = [], 0
            for found in added.finditer(text) if added else ():
                out += [whole.encode(text[at : found.start()]), id_of[found.lastgroup]]
                at = found.end()
            return b"".join([*out, whole.encode(text[at:])])

        return encode

    def build():
        encode = remembered(definition, make)
        return lambda texts: [encode(text) for text in texts]

    return build
