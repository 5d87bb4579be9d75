"""N-gram Jaccard join: exact links between texts whose shingle sets are alike.

Equal sets are one class, so copies are never paired. Sets are ordered by one global order, frequent
shingles last. Two linked sets share some shingles within their first ones (prefixes), so classes
meet in index lists of prefix shingles:

* Lists up to a bound give pairs. Those that share enough of these lists are counted exactly.
* Longer lists that begin with the same class are read as one, as those of a group of near copies
  hold nearly the same sets. They are cut into blocks by size, position and a hash. Pairs of blocks
  that sizes or positions rule out are skipped. A remaining pair of blocks brings its whole sets into one task of
  bounded size. There the overlaps of a set with all sets of the block are derived from those of
  the set before it, by the shingles in which the two differ, and only links that join something
  new leave the task. So a group of near copies never becomes all its pairs.

Any global order gives the same links; the one used comes from counts over all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayscope.sources.staging import Scratch, stage

from .components import components
from .remembered import remembered
from .text import few_rows

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles (fewer words: all as one shingle)."""
    words = text.translate(_LOWER).split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)] if words else [], np.uint64).view(np.int64)
    hash_of = remembered("hashes of words", _WordHashes).__getitem__
    hashes = np.fromiter(map(hash_of, words), np.uint64, len(words))
    n = len(words) - k + 1
    mixed = hashes[:n].copy()
    for j in range(1, k):
        mixed = mixed * _M[0] + hashes[j : j + n]
    for shift, factor in ((30, _M[1]), (27, _M[2])):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * factor
    return np.unique((mixed ^ (mixed >> np.uint64(31))).view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.binary()):
        yield value.as_py() or b""


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *sets]))


def _range_end(share: float) -> int:
    """Hashes below it are about that share of all hashes."""
    return int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1


def frequent_shingles(
    scratch: Scratch, texts: DataFrame, k: int, share: float, most: int = 2_000_000, held: int = 2_000_000
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of shingles that are in more than one text, at most ``most``.

    All texts are counted. In the lower ``share`` of the hash range every shingle is; beyond it just
    those found more than twice among ``held`` shingles of a task. If more than ``most`` shingles
    repeat, the less frequent ones count as single. The result only orders shingles, so none of this
    changes any link.
    """
    end = _range_end(share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            told = (values < end) | (counts > 2)
            return pa.RecordBatch.from_arrays([pa.array(values[told]), pa.array(counts[told])], ["shingle", "n"])

        sets, size = [], 0
        for batch in few_rows(batches):
            for text in _texts(batch):
                sets.append(shingle_set(text, k))
                size += len(sets[-1])
                if size >= held:
                    yield counted()
                    sets, size = [], 0
        if size:
            yield counted()

    counted = texts.select("text").mapInArrow(count, "shingle long, n long")
    counts = scratch.stage(counted.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "counts")
    # By powers of two: the lowest bound that leaves no more than ``most``.
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect()
    total, bound = 0, 64
    for level, n in sorted(((r["level"], r["n"]) for r in levels), reverse=True):
        if total + n > most:
            break
        total, bound = total + n, level
    table = counts.where(F.floor(F.log2("n")) >= bound).toArrow()
    values, n = np.asarray(table["shingle"], np.int64), np.asarray(table["n"], np.int32)
    order = np.argsort(values)
    return values[order], n[order]


def _in_order(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], end: int) -> np.ndarray:
    """Shingles by frequency, then hash: single ones of the counted range first, unknown ones as if
    they were in three texts."""
    values, counts = frequent
    weight = np.where(own < end, 1, 3)
    if len(values):
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        weight = np.where(values[at] == own, counts[at], weight)
    return own[np.lexsort((own, weight))]


class Threshold:
    """Jaccard of at least ``percent`` / 100, in whole numbers.

    Prefixes are so long that linked sets share ``shared`` shingles there, or all of their common
    ones if these are fewer.
    """

    def __init__(self, percent: int, shared: int = 3):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1 to 100")
        self.percent, self.shared = percent, shared

    def prefix(self, n: int) -> int:
        """Length of the prefix of a set; 0 if only an equal set can be linked with it."""
        if 100 * n < self.percent * (n + 1):
            return 0
        return min(n, n - -(-self.percent * n // 100) + self.shared)

    def links(self, inter, n_a, n_b):
        return 100 * inter >= self.percent * (n_a + n_b - inter)

    def needed(self, n_a, n_b):
        """Column: the smallest overlap that links sets of these sizes."""
        return F.ceil(F.lit(self.percent) * (n_a + n_b) / F.lit(100 + self.percent) - F.lit(1e-9))


def _describe(texts: DataFrame, k: int, threshold: Threshold, frequent, share: float) -> DataFrame:
    """Rows with n_shingles, signature of the set, and its prefix in the global order."""
    shared, end = texts.sparkSession.sparkContext.broadcast(frequent), _range_end(share)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in few_rows(batches):
            sizes, signatures, prefixes = [], [], []
            for text in _texts(batch):
                own = shingle_set(text, k)
                sizes.append(len(own))
                signatures.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                length = threshold.prefix(len(own)) if len(own) else 0
                prefixes.append(_in_order(own, frequent, end)[:length] if length else own[:0])
            columns = [
                batch.column("id"),
                batch.column("body"),
                pa.array(sizes, pa.int64()),
                pa.array(signatures, pa.binary()),
                _lists(prefixes),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "body", "n", "signature", "prefix"])

    made = StructType.fromDDL("n bigint, signature binary, prefix array<bigint>")
    return texts.mapInArrow(describe, StructType([*texts.select("id", "body").schema.fields, *made.fields]))


def _whole_sets(texts: DataFrame, k: int) -> DataFrame:
    """class and shingles (sorted) of rows with class and text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            sets = [shingle_set(text, k) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), _lists(sets)], ["class", "shingles"])

    return texts.select("class", "text").mapInArrow(build, "class long, shingles array<bigint>")


def join_blocks(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: Threshold) -> list[tuple[int, int]]:
    """Links between two blocks of sets (or within one) that span what is linked.

    Numbers of b follow those of a. Overlaps of a set are those of the set before it, plus one for
    every index entry of a shingle it has more, minus one for every entry of a shingle it lacks.
    """
    inside = sets_b is None
    other = sets_a if inside else sets_b
    sizes = np.array([len(s) for s in other], np.int64)
    owners = np.repeat(np.arange(len(other)), sizes)
    shingles = np.concatenate(other)
    order = np.argsort(shingles, kind="stable")
    shingles, owners = shingles[order], owners[order]

    def entries(wanted: np.ndarray) -> np.ndarray:
        """How many of the wanted shingles each set of the block has."""
        low, high = np.searchsorted(shingles, wanted, "left"), np.searchsorted(shingles, wanted, "right")
        lengths = high - low
        places = np.repeat(high - np.cumsum(lengths), lengths) + np.arange(lengths.sum())
        return np.bincount(owners[places], minlength=len(other))

    shift = 0 if inside else len(sets_a)
    group = np.arange(shift + len(other))
    links: list[tuple[int, int]] = []
    last, overlaps = np.empty(0, np.int64), np.zeros(len(other), np.int64)
    # Like sets follow each other when sets are visited by their smallest shingles.
    for x in sorted(range(len(sets_a)), key=lambda i: (sets_a[i][:4].tolist(), len(sets_a[i]))):
        own = sets_a[x]
        more = np.setdiff1d(own, last, assume_unique=True)
        if 2 * len(more) < len(own):
            less = np.setdiff1d(last, own, assume_unique=True)
            overlaps = overlaps + entries(more) - entries(less)
        else:
            overlaps = entries(own)
        last = own
        linked = np.flatnonzero(threshold.links(overlaps, len(own), sizes)) + shift
        linked = linked[group[linked] != group[x]]
        if len(linked):
            groups, first = np.unique(group[linked], return_index=True)
            links += [(x, int(y)) for y in linked[first]]
            group[np.isin(group, groups)] = group[x]
    return links


def _block_links(threshold: Threshold):
    def link(table: pa.Table) -> pa.Table:
        classes = np.asarray(table["class"])
        flat = table["shingles"].combine_chunks()
        sets = np.split(np.asarray(flat.values), np.asarray(flat.offsets)[1:-1])
        side = np.asarray(table["side"])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = join_blocks([sets[i] for i in a], [sets[i] for i in b] if len(b) else None, threshold)
        ids = classes[np.r_[a, b]]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pairs[:, 0]], "b": ids[pairs[:, 1]]})

    return link


def _blocks(
    scratch: Scratch, entries: DataFrame, threshold: Threshold, block_sets: int, block_shingles: int
) -> DataFrame:
    """Pairs of blocks (token, block1, block2), with side and class of every set in them."""
    # Linked sets are in the same or neighbouring size classes.
    ratio = math.log(100 / threshold.percent) * 1.0001 if threshold.percent < 100 else 1e9
    heads = entries.groupBy("token").agg(F.min("class").alias("head"))
    members = (
        entries.join(heads, "token")
        .groupBy(F.col("head").alias("token"), "class", "n")
        .agg(F.min("pos").alias("pos"), F.max("entries").alias("entries"))
    )
    placed = members.select(
        "token",
        "class",
        "n",
        (F.col("n") - F.col("pos")).alias("rest"),
        F.floor(F.log("n") / ratio).alias("size"),
        # Positions in steps of a quarter of the usual prefix.
        F.when(
            F.col("entries") > block_sets,
            F.floor(400 * F.col("pos") / ((100 - threshold.percent) * F.col("n") + 100)),
        )
        .otherwise(0)
        .alias("depth"),
    )
    where = ["token", "size", "depth"]
    pieces = placed.groupBy(*where).agg(
        F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum("n") / block_shingles)).alias("pieces")
    )
    cut = placed.join(pieces, where).withColumn("piece", F.pmod(F.xxhash64("class"), F.col("pieces")))
    cut = scratch.stage(cut.withColumn("block", F.xxhash64(*where, "piece")), "blocks")
    known = cut.groupBy("token", "block", "size").agg(F.min("n").alias("least"), F.max("rest").alias("rest"))
    one, two = (known.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("block", "size", "least", "rest")]) for i in (1, 2))
    pairs = one.join(two, "token").where(
        (F.col("block1") <= F.col("block2"))
        & (F.abs(F.col("size1") - F.col("size2")) <= 1)
        # Before the first long list in common, a pair that is not counted by its short lists has
        # fewer than ``shared`` shingles in common.
        & (F.least("rest1", "rest2") + (threshold.shared - 1) >= threshold.needed(F.col("least1"), F.col("least2")))
    )
    pairs = pairs.select("token", "block1", "block2")
    sides = [
        cut.select("token", F.col("block").alias(f"block{side + 1}"), "class")
        .join(chosen, ["token", f"block{side + 1}"])
        .select("token", "block1", "block2", F.lit(side).alias("side"), "class")
        for side, chosen in ((0, pairs), (1, pairs.where("block1 != block2")))
    ]
    return sides[0].union(sides[1])


def link_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = 5,
    percent: int = 80,
    list_entries: int = 12,
    block_sets: int = 2048,
    block_shingles: int = 1_500_000,
) -> DataFrame:
    """Per row: key, body (MD5 of the text), n_shingles, component, group.

    ``group`` is the same for linked texts and no others (the smallest signature among them; null for
    texts without words), whatever their keys. ``component`` is the smallest key reachable over links of at least ``percent`` / 100, the row's
    own included. Texts without words are in no links and keep their own key. Equal sets are linked.
    Null keys take part and get the smallest key of their component, null if there is none. Repeated
    rows are linked as equal sets. Other columns are not read. ``list_entries``, ``block_sets`` and
    ``block_shingles`` bound the work of one task; they leave no pair out.
    """
    with Scratch(docs.sparkSession) as scratch:
        return _link_texts(scratch, docs, key, text, k, Threshold(percent), list_entries, block_sets, block_shingles)


#: Up to so many wanted rows (of about 60 bytes) are sent to every executor.
_BROADCAST_ROWS = 150_000
#: The same for list sizes (16 bytes each).
_BROADCAST_TOKENS = 500_000


def _link_texts(scratch, docs, key, text, k, threshold, list_entries, block_sets, block_shingles) -> DataFrame:
    texts = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("body", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    # A prefix takes 1 - threshold of a set; twice that share has enough single shingles to choose from.
    share = min(1.0, 2 * (1 - threshold.percent / 100) + 0.05)
    frequent = frequent_shingles(scratch, texts, k, share)
    described = scratch.stage(_describe(texts, k, threshold, frequent, share), "sets")
    classes = (
        described.where("n > 0")
        .groupBy("signature")
        .agg(
            F.min(F.struct("id", "body")).alias("example"),
            F.min("id").alias("first_id"),
            F.first("n").alias("n"),
            F.first("prefix").alias("prefix"),
        )
        .withColumn("class", F.monotonically_increasing_id())
    )
    classes = scratch.stage(classes, "classes")

    postings = classes.select("class", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = postings.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1")
    lists = scratch.stage(lists, "list-sizes")
    few = lists.count() <= _BROADCAST_TOKENS
    entries = scratch.stage(postings.join(F.broadcast(lists) if few else lists, "token"), "lists")

    short = entries.where(F.col("entries") <= list_entries)
    one, two = (short.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("class", "n", "pos")]) for i in (1, 2))
    needed = threshold.needed(F.col("n1"), F.col("n2"))
    pairs = (
        one.join(two, "token")
        .where((F.col("class1") < F.col("class2")) & (F.least("n1", "n2") >= needed))
        .groupBy(F.col("class1").alias("a"), F.col("class2").alias("b"), "n1", "n2")
        .agg(F.count("*").alias("shared"))
        # A linked pair with fewer short lists in common has a long one in common.
        .where(F.col("shared") >= F.least(F.lit(threshold.shared), needed))
    )
    pairs = scratch.stage(pairs, "pairs")
    long = entries.where(F.col("entries") > list_entries)
    units = scratch.stage(_blocks(scratch, long, threshold, block_sets, block_shingles), "units")

    asked = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(units.select("class")).distinct()
    examples = asked.join(classes.select("class", "example.id", "example.body"), "class")
    wanted = scratch.stage(examples.select("class", F.col("id").alias("of_id"), F.col("body").alias("of_body")), "wanted")
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("body") == F.col("of_body"))
    few = wanted.count() <= _BROADCAST_ROWS
    rows = texts.join(F.broadcast(wanted) if few else wanted, same)
    sets = _whole_sets(rows, k)
    repeated = described.join(wanted, same).groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        sets = sets.dropDuplicates(["class"])
    sets = scratch.stage(sets, "whole-sets")

    counted = (
        pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b")), "b")
        .withColumn("inter", F.size(F.array_intersect("set_a", "set_b")).cast("long"))
        .where(threshold.links(F.col("inter"), F.col("n1"), F.col("n2")))
        .select("a", "b")
    )
    counted = scratch.stage(counted, "pair-links")
    in_blocks = (
        units.join(sets, "class")
        .groupBy("token", "block1", "block2")
        .applyInArrow(_block_links(threshold), "a long, b long")
    )
    in_blocks = scratch.stage(in_blocks.distinct(), "block-links")
    roots = components(counted.union(in_blocks))
    of_class = classes.select("class", "first_id", "signature").join(roots, F.col("class") == F.col("node"))
    smallest = of_class.groupBy("root").agg(F.min("first_id").alias("smallest"), F.min("signature").alias("group"))
    linked = of_class.join(smallest, "root").select(F.col("class").alias("linked"), "smallest", "group")
    named = classes.join(linked, F.col("class") == F.col("linked"), "left").select(
        F.col("signature").alias("of"),
        F.coalesce("smallest", "first_id").alias("named"),
        F.coalesce("group", "signature").alias("group"),
    )
    done = described.join(named, F.col("signature") == F.col("of"), "left")
    result = done.select(
        F.col("id").alias(key), "body", F.col("n").alias("n_shingles"), F.coalesce("named", "id").alias("component"), "group"
    )
    return stage(result, "groups")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of linked texts (the one with the smallest key), columns as they were.

    Rows without words all stay. Of repeated rows (same key and text) one stays. Null keys come
    last, unless a group has no others.
    """
    groups = link_texts(docs, key, text, **options)
    worded = groups.where("n_shingles > 0").select(F.col(key).alias("id"), "body", "group")
    rank = F.struct(F.col("id").isNull().alias("no_key"), "id", "body")
    best = worded.groupBy(F.col("group").alias("of")).agg(F.min(rank).alias("best"))
    losers = (
        worded.join(best, F.col("group") == F.col("of"))
        .where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("body") == F.col("best.body"))))
        .select(F.col("id").alias("lost_id"), F.col("body").alias("lost_body"))
        .distinct()
    )
    repeats = (
        worded.groupBy(F.col("id").alias("lost_id"), F.col("body").alias("lost_body"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    body = F.unhex(F.md5(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")))
    rows = docs.select(row, F.col(key).alias("id"), body.alias("body"))
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("body") == F.col("lost_body"))
    left = rows.join(losers, same, "left_anti")
    once = left.join(repeats, same, "left_semi").dropDuplicates(["id", "body"])
    return left.join(repeats, same, "left_anti").union(once).select("row.*")
