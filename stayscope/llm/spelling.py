"""Spelling variants: words one edit apart, found through Bloom filters of the vocabulary.

Every word generates its deletions and its replacements by greater characters, so that each pair of
near words comes up once: an insertion is a deletion of the longer word. Edits are probed, as numbers,
against blocked Bloom filters with one shard per word length. Only the few that a filter lets through become
strings and are shuffled to an exact join with the vocabulary, which removes the false ones.

A filter that is sent to all tasks has a fixed greatest size. A larger vocabulary is cut into
slices by a hash, and the edits are probed slice by slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.sources.staging import Scratch, stage

#: Characters of words: small Latin letters and the Latin letters (and two signs) from U+00C0 to U+00FF.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Bits of a filter per word, and bytes of one filter at most.
WORD_BITS, FILTER_BYTES = 32, 16 << 20
_EDITS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [1]


def _power(n: int) -> np.ndarray:
    """The base's powers up to the n-th; numbers wrap at 64 bits."""
    while len(_POWERS) < n:
        _POWERS.append(_POWERS[-1] * _BASE % (1 << 64))
    return np.array(_POWERS[:n], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of 64 bits and the four bits in it of mixed hashes."""
    one, low = np.uint64(1), np.uint64(63)
    bits = one << (h & low)
    for shift in (6, 12, 18):
        bits |= one << ((h >> np.uint64(shift)) & low)
    return ((h >> np.uint64(24)) % np.uint64(blocks)).astype(np.int64), bits


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the list, code points as a table) for each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        joined = "".join([words[i] for i in at])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(at), n)
        yield int(n), at, codes


def _slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (_mixed(h + np.uint64(1)) >> np.uint64(33)) % np.uint64(slices)


def _filter_rows(sizes: dict[int, int], slices: int, this: int):
    """Task function: (length, block, bits) of the words in one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, _, codes in _by_length(batch["word"].to_pylist()):
                h = _mixed((codes.astype(np.uint64) * _power(n)).sum(1, dtype=np.uint64))
                block, bits = _places(h[_slice_of(h, slices) == this], sizes[n])
                yield pa.RecordBatch.from_pydict(
                    {"length": pa.array(np.full(len(block), n), pa.int32()), "block": block, "bits": bits.view(np.int64)}
                )

    return run


def _filters(words: DataFrame, counts: dict[int, int], slices: int, this: int) -> dict[int, np.ndarray]:
    """One shard per length. Blocks are joined in Spark; at most FILTER_BYTES of bits and their places come back."""
    sizes = {n: max(-(-c * WORD_BITS // slices // 64), 1) for n, c in counts.items()}
    rows = words.select("word").mapInArrow(_filter_rows(sizes, slices, this), "length int, block long, bits long")
    table = rows.groupBy("length", "block").agg(F.bit_or("bits").alias("bits")).toArrow()
    shards = {n: np.zeros(size, np.uint64) for n, size in sizes.items()}
    length, block, bits = (table[c].to_numpy() for c in ("length", "block", "bits"))
    for n, shard in shards.items():
        here = length == n
        shard[block[here]] = bits[here].view(np.uint64)
    return shards


def _found(shards: dict[int, np.ndarray], n: int, h: np.ndarray) -> np.ndarray:
    """Which raw hashes of words of length ``n`` the filter lets through."""
    if n not in shards:
        return np.zeros(h.shape, bool)
    block, bits = _places(_mixed(h), len(shards[n]))
    return shards[n][block] & bits == bits


def _edits(shards: dict[int, np.ndarray], codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, code points of the edit) of all edits that the filters let through."""
    count, n = codes.shape
    power, inverse = _power(n), np.uint64(_INVERSE)
    terms = codes.astype(np.uint64) * power
    h = terms.sum(1, dtype=np.uint64)
    before = np.zeros(count, np.uint64)
    for i in range(n):
        # Deletions; the second of two equal characters stands for the first.
        hit = _found(shards, n - 1, before + (h - before - terms[:, i]) * inverse)
        if i + 1 < n:
            hit &= codes[:, i] != codes[:, i + 1]
        at = np.flatnonzero(hit)
        if len(at):
            yield at, np.delete(codes[at], i, axis=1)
        wide = (h - terms[:, i])[:, None] + (alphabet.astype(np.uint64) * power[i])[None, :]
        at, to = np.nonzero(_found(shards, n, wide) & (alphabet[None, :] > codes[:, i][:, None]))
        if len(at):
            changed = codes[at].copy()
            changed[:, i] = alphabet[to]
            yield at, changed
        before += terms[:, i]


def _probe(filters, alphabet: np.ndarray):
    """Task function: (word, n, edit) of every edit that may be a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = filters.value
        for batch in batches:
            for n, at, codes in _by_length(batch["word"].to_pylist()):
                step = max(_EDITS // len(alphabet), 1)
                for start in range(0, len(at), step):
                    for hit, changed in _edits(shards, codes[start : start + step], alphabet):
                        width = changed.shape[1]
                        text = changed.astype("<u4").tobytes().decode("utf-32-le")
                        rows = batch.take(pa.array(at[start + hit]))
                        edits = [text[k * width : (k + 1) * width] for k in range(len(rows))]
                        yield pa.RecordBatch.from_arrays([rows["word"], rows["n"], pa.array(edits)], ["word", "n", "edit"])

    return run


def near_words(vocabulary: DataFrame, alphabet: str = ALPHABET, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, near, near_n) for all pairs of words that differ by one code point, both ways.

    ``vocabulary`` holds each ``word`` once, with ``n``, and has been written: it is read several
    times. A replacing character must be of the alphabet; only those that occur in words are tried.
    """
    counts = {r["k"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("k")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    used = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c").isin(list(alphabet)))
    codes = np.array(sorted(ord(r["c"]) for r in used.distinct().collect()), np.uint32)
    spark = vocabulary.sparkSession
    words = vocabulary.repartition(max(-(-total // 20_000), 1), "word")
    slices = max(-(-total * WORD_BITS // 8 // filter_bytes), 1)
    found = None
    for this in range(slices if len(codes) else 0):
        filters = spark.sparkContext.broadcast(_filters(words, counts, slices, this))
        part = words.select("word", "n").mapInArrow(_probe(filters, codes), "word string, n long, edit string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vocabulary.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    exact = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    # An edit that filters of several slices let through comes more than once.
    pairs = (found.distinct() if slices > 1 else found).join(exact, "edit")
    both = F.array(
        F.struct(F.col("word"), F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
        F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def _roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): each round follows twice as many steps as the one before."""
    ups = forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        further = ups.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ups = ups.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return ups


def count_words(words: DataFrame, word: str = "word", min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n) of the distinct words with enough characters and occurrences."""
    long = words.where(F.length(word) >= min_chars).groupBy(F.col(word).alias("word"))
    return long.agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def group_variants(
    vocabulary: DataFrame, ratio: int = 10, alphabet: str = ALPHABET, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    ``form`` is the near word with the largest ``n`` (ties: the smallest in code-point order), if that is at
    least ``ratio`` times the word's own; else null, as is ``form_n``. ``root`` follows forms to the
    last one. Words are near if they differ by exactly one inserted, deleted or replaced code point.

    Null words and counts are left out; an empty word is near words of one character; repeated words are added up.
    Other columns change nothing. An empty vocabulary gives no rows. A word has at most as many near
    words as edits, so no key of a join is unbounded.
    """
    if ratio <= 1:
        raise ValueError("ratio must exceed 1, or forms could lead in a circle")
    with Scratch(vocabulary.sparkSession) as scratch:
        summed = vocabulary.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
        words = scratch.stage(summed, "vocabulary")
        near = near_words(words, alphabet, filter_bytes).groupBy("word").agg(
            F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
        )
        best_n = -F.col("best.less")
        chosen = F.coalesce(best_n >= F.col("n") * ratio, F.lit(False))
        forms = scratch.stage(
            words.join(near, "word", "left").select(
                "word",
                F.when(chosen, F.col("best.near")).alias("form"),
                "n",
                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.when(chosen, best_n).alias("form_n"),
            ),
            "forms",
        )
        # Counts grow by the ratio at each step, so the longest way is known.
        most = words.agg(F.max("n")).first()[0] or 1
        steps = max(math.ceil(math.log(max(most, 1)) / math.log(ratio)), 1)
        roots = _roots(forms, math.ceil(math.log2(steps)))
        return stage(
            forms.join(roots, "word", "left").select(
                "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
            ),
            "variants",
        )
