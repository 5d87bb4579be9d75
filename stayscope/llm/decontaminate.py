"""Benchmark decontamination: one Aho-Corasick automaton over windows of the benchmark's items.

Windows are runs of consecutive words of an item. Texts are normalised byte for byte, so every
place keeps its offset, then their words are joined by single spaces and scanned once. Places that
match are turned into word numbers and, through the word list, into offsets of the original text.

The benchmark is cut into blocks of bounded size, each one automaton. A usual benchmark is one
block and one pass. Further blocks are further passes over a written table that carries the hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayscope.sources.staging import stage

from .text import few_rows, words_of

#: Bytes to their normal form: A-Z in lower case, what is between words to spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


class PassageFinder:
    """Automaton of one block: (window of words joined by spaces, ids of its items)."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self._automaton = ahocorasick.Automaton()
        for window, items in windows:
            # One character per byte: places in the text are then byte offsets.
            key = f" {window} ".encode().decode("latin-1")
            self._automaton.add_word(key, (len(key), window.count(" ") + 1, items))
        self._empty = not windows
        if windows:
            self._automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, hit ranges of word numbers (last included), items."""
        words = text.translate(_FOLD).split()
        ranges, items = [], set()
        if words and not self._empty:
            joined = b" " + b" ".join(words) + b" "
            hits = list(self._automaton.iter(joined.decode("latin-1")))
            if hits:
                gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                starts = np.searchsorted(gaps, [end - size + 1 for end, (size, _, _) in hits])
                for first, (_, (_, n, ids)) in zip(starts.tolist(), hits):
                    ranges.append((first, first + n - 1))
                    items.update(ids)
        return len(words), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap; ranges that touch are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def original_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Code-point offsets (end excluded) of word ranges in the text as it was."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [
        {"start": int(points[places[first][0]]), "end": int(points[places[last][1]])} for first, last in ranges
    ]


def benchmark_windows(benchmark: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Distinct windows: window, items (ids as text). Items without words have none."""
    words = words_of(F.col(text))
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))),
        lambda i: F.array_join(F.slice("words", i, size), " "),
    )
    return (
        benchmark.select(F.col(key).cast("string").alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item", F.explode(F.array_distinct(cut)).alias("window"))
        .groupBy("window")
        .agg(F.collect_set(F.coalesce("item", F.lit("null"))).alias("items"))
    )


_RANGE_DDL = "array<struct<first:bigint,last:bigint>>"
_CARRIED = f"text string, ranges {_RANGE_DDL}, items array<string>"
_DONE = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_RANGE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(shared, last_pass: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = PassageFinder(shared.value)
        for batch in few_rows(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            before = zip(batch.column("ranges").to_pylist(), batch.column("items").to_pylist())
            n_words, ranges, items, spans, n_hit = [], [], [], [], []
            for raw, (old_ranges, old_items) in zip(texts, before):
                n, new_ranges, new_items = finder.scan(raw or b"")
                ranges_now = merged([(r["first"], r["last"]) for r in old_ranges or ()] + new_ranges)
                n_words.append(n)
                items.append(sorted(new_items.union(old_items or ())))
                n_hit.append(sum(last - first + 1 for first, last in ranges_now))
                if last_pass:
                    spans.append(original_spans(raw or b"", ranges_now))
                else:
                    ranges.append([{"first": a, "last": b} for a, b in ranges_now])
            columns = {"kept": batch.column("kept")}
            if last_pass:
                columns |= {
                    "n_words": pa.array(n_words, pa.int64()),
                    "n_hit": pa.array(n_hit, pa.int64()),
                    "items": pa.array(items, pa.list_(pa.string())),
                    "spans": pa.array(spans, _SPAN),
                }
            else:
                columns |= {
                    "text": batch.column("text"),
                    "ranges": pa.array(ranges, _RANGE),
                    "items": pa.array(items, pa.list_(pa.string())),
                }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return scan


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 2_000_000,
) -> DataFrame:
    """Per row: kept (a struct of the ``keep`` columns), n_words, n_hit, items, spans.

    ``items`` are the ids, sorted as text, of items of which a window occurs; ``spans`` the hit
    places of the original text in code points. Items shorter than ``window`` are one window.
    ``block_bytes`` bounds the window text of one automaton (about 60 bytes of memory each byte).

    Null texts and items have no words. Rows are scanned each by itself: repeated rows, ties and
    null keys keep their own results. Columns named like a result are safe inside ``kept``. An empty
    benchmark hits nothing. Null item ids count as the id "null".
    """
    spark = docs.sparkSession
    windows = stage(benchmark_windows(benchmark, item_key, item_text, window), "windows")
    total = windows.agg(F.sum(F.octet_length("window") + 8 * F.size("items"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    none = F.lit(None).cast(_RANGE_DDL).alias("ranges"), F.lit(None).cast("array<string>").alias("items")
    rows = docs.select(kept, F.col(text).cast("string").alias("text"), *none)
    kept_type = rows.schema["kept"].dataType
    for block in range(n_blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        shared = spark.sparkContext.broadcast([(r["window"], r["items"]) for r in part.collect()])
        last_pass = block == n_blocks - 1
        schema = StructType.fromDDL(_DONE if last_pass else _CARRIED)
        schema = StructType([*StructType().add("kept", kept_type).fields, *schema.fields])
        rows = rows.mapInArrow(_scanner(shared, last_pass), schema)
        if not last_pass:
            rows = stage(rows, "passages")
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows without any benchmark passage, with the columns of ``docs``."""
    found = find_passages(docs, benchmark, docs.columns, text, **options)
    return found.where(F.col("n_hit") == 0).select("kept.*")
