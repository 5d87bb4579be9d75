"""Hard negatives by segment summaries.

A vector is cut into segments, and each segment's mean and deviation are stored, both times the root
of its length. Within a segment the inner product of two vectors is the product of the means plus
what the deviations allow: at most their product, at least minus it. So sums over segments bound a
score from both sides. Pairs are looked at with few long segments, then with many short ones, and only
pairs whose bounds still reach a wanted range are scored exactly.

Anchors meet all rows block by block: both are dealt over blocks of bounded size, and every pair of
blocks is one group of a cogroup. A group returns only its best few rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayscope.sources.staging import Scratch, stage

SEGMENTS, COARSE = 16, 4
#: Sums of squares below this keep 100 times a score within 64 bits.
_WIDEST = float(2**55)
_EXACT = float(2**53)
#: Share of a tile's pairs from which the whole tile is computed at once.
_DENSE = 0.1
_NO_ID = np.iinfo(np.int64).max


def summarised(vectors: DataFrame, key: str, label: str, vector: str, is_anchor: Column) -> DataFrame:
    """Rows that take part: row, id, label, q (whole components), means, deviations, is_anchor."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0).cast("double"))
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("q"), is_anchor.alias("is_anchor")
    )
    rows = rows.where(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x) < _WIDEST)
    edge = lambda s: F.floor(s * F.size("q") / SEGMENTS).cast("int")
    rows = rows.withColumn(
        "parts",
        F.transform(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: F.slice("q", edge(s) + 1, edge(s + 1) - edge(s))),
    )
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    mean = lambda part: F.when(F.size(part) > 0, total(part) / F.size(part)).otherwise(0.0)
    rows = rows.withColumn("mean", F.transform("parts", mean))
    spread = F.zip_with("parts", "mean", lambda part, m: F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))))
    weighted = F.zip_with("parts", "mean", lambda part, m: m * F.sqrt(F.size(part).cast("double")))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        "label",
        F.transform("q", lambda x: x.cast("long")).alias("q"),
        weighted.cast("array<float>").alias("means"),
        spread.cast("array<float>").alias("deviations"),
        "is_anchor",
    )


class _Side:
    """Vectors of one length: rows, ids, labels, exact components and bounds of every level."""

    def __init__(self, table: pa.Table, at: np.ndarray, labels: np.ndarray, n_dims: int):
        self.at, self.label = at, labels[at]
        table = table.take(pa.array(at))
        self.row = table["row"].to_numpy()
        self.id = table["id"].fill_null(_NO_ID).to_numpy()
        self.no_id = np.asarray(table["id"].is_null())
        flat = lambda name, kind, n: _flat(table[name]).astype(kind).reshape(len(at), n)
        self.q = flat("q", np.int64, n_dims)
        square = float((self.q.astype(float) ** 2).sum(1).max(initial=0))
        self.small = square < _EXACT
        self.x = self.q.astype(float) if self.small else self.q
        means, deviations = flat("means", float, SEGMENTS), flat("deviations", float, SEGMENTS)
        # The last column of the deviations pays for rounding: a hundred-thousandth of the norms' product.
        norm = np.sqrt((means**2 + deviations**2).sum(1, keepdims=True)) * 10**-2.5 + 1e-3
        lengths = np.diff(np.arange(SEGMENTS + 1) * n_dims // SEGMENTS)
        coarse = self._joined(means, deviations, lengths)
        self.levels = [(m, np.hstack([d, norm])) for m, d in (coarse, (means, deviations))]

    @staticmethod
    def _joined(means, deviations, lengths):
        """Summaries of longer segments from those of their parts."""
        n = lengths.reshape(COARSE, -1)
        cut = lambda table: table.reshape(len(table), COARSE, -1)
        mean = (cut(means) * np.sqrt(n)).sum(2) / np.sqrt(np.maximum(n.sum(1), 1))
        squares = (cut(means) ** 2 + cut(deviations) ** 2).sum(2)
        return mean, np.sqrt(np.maximum(squares - mean**2, 0))


def _flat(lists) -> np.ndarray:
    values = [chunk.flatten() for chunk in lists.chunks]
    return np.concatenate([v.to_numpy(zero_copy_only=False) for v in values]) if values else np.empty(0)


def _sides(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[_Side, _Side]]:
    """Both sides for each length of vectors; other lengths have no inner product."""
    if not len(anchors) or not len(rows):
        return
    lengths = [np.asarray(pc.list_value_length(t["q"])) for t in (anchors, rows)]
    codes = pa.chunked_array([*anchors["label"].chunks, *rows["label"].chunks], anchors["label"].type)
    codes = codes.combine_chunks().dictionary_encode().indices.to_numpy()
    labels = codes[: len(anchors)], codes[len(anchors) :]
    for n in np.intersect1d(*lengths):
        yield tuple(_Side(t, np.flatnonzero(k == n), c, int(n)) for t, k, c in zip((anchors, rows), lengths, labels))


def _scored(a: _Side, r: _Side, ai, ri, low, high, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of wanted pairs of a tile whose bounds reach from low to high, by anchor."""
    live, pairs = wanted, None
    for (am, ad), (rm, rd) in zip(a.levels, r.levels):
        if pairs is None:
            means, spread = am[ai] @ rm[ri].T, ad[ai] @ rd[ri].T
            live = live & (means + spread >= low[:, None]) & (means - spread <= high[:, None])
            if np.count_nonzero(live) < _DENSE * live.size:
                pairs = np.nonzero(live)
        else:
            i, j = pairs
            means = np.einsum("ij,ij->i", am[ai[i]], rm[ri[j]])
            spread = np.einsum("ij,ij->i", ad[ai[i]], rd[ri[j]])
            left = (means + spread >= low[i]) & (means - spread <= high[i])
            pairs = i[left], j[left]
    exact = (a.x, r.x) if a.small and r.small else (a.q, r.q)
    if pairs is None:
        scores = exact[0][ai] @ exact[1][ri].T
        i, j = np.nonzero(live)
        return i, j, scores[i, j].astype(np.int64)
    i, j = pairs
    scores = np.einsum("ij,ij->i", exact[0][ai[i]], exact[1][ri[j]])
    return i, j, scores.astype(np.int64)


class _Best:
    """The first ``k`` rows per slot: higher scores first, then smaller ids, null ids last."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.at = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        #: Scores below this can't enter any more.
        self.floor = np.full(slots, -np.inf)

    def add(self, slot, score, at, r: _Side) -> None:
        keep = score >= self.floor[slot]
        if not keep.any():
            return
        slot, score, at = (np.concatenate([old, new[keep]]) for old, new in ((self.slot, slot), (self.score, score), (self.at, at)))
        order = np.lexsort((r.row[at], r.id[at], r.no_id[at], -score, slot))
        slot, score, at = slot[order], score[order], at[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        self.slot, self.score, self.at, place = slot[kept], score[kept], at[kept], place[kept]
        full = place == self.k - 1
        self.floor[self.slot[full]] = self.score[full]


def _tiles(n: int, size: int, first: int | None = None) -> Iterator[np.ndarray]:
    """Index ranges; a small first one sets thresholds early."""
    at = 0
    while at < n:
        step = first if first and at == 0 else size
        yield np.arange(at, min(at + step, n))
        at += step


_FOUND = "anchor long, place int, other long, id long, score long"


def _result(a: _Side, r: _Side, best: _Best, per_anchor: int) -> pa.Table:
    return pa.table(
        {
            "anchor": pa.array(a.row[best.slot // per_anchor], pa.int64()),
            "place": pa.array(best.slot % per_anchor, pa.int32()),
            "other": pa.array(r.row[best.at], pa.int64()),
            "id": pa.array(r.id[best.at], pa.int64(), mask=r.no_id[best.at]),
            "score": pa.array(best.score, pa.int64()),
        }
    )


_NONE = pa.schema([("anchor", pa.int64()), ("place", pa.int32()), ("other", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]).empty_table()


def _positives(k: int):
    """The first ``k`` rows of the anchor's own label within a group."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [_NONE]
        for a, r in _sides(anchors, rows):
            best = _Best(len(a.row), k)
            by_label = np.argsort(r.label, kind="stable")
            own = np.argsort(a.label, kind="stable")
            for label in np.unique(a.label):
                mine = own[slice(*np.searchsorted(a.label[own], [label, label + 1]))]
                its = by_label[slice(*np.searchsorted(r.label[by_label], [label, label + 1]))]
                for t in _tiles(len(mine), 512):
                    ai = mine[t]
                    for u in _tiles(len(its), 2048, 256):
                        ri = its[u]
                        high = np.full(len(ai), np.inf)
                        others = a.row[ai][:, None] != r.row[ri][None, :]
                        i, j, score = _scored(a, r, ai, ri, best.floor[ai], high, others)
                        best.add(ai[i], score, ri[j], r)
            parts.append(_result(a, r, best, 1))
        return pa.concat_tables(parts)

    return run


def _negatives(n_positive: int, k: int, low: int, high: int):
    """For each positive of an anchor, the first ``k`` rows of other labels in its range."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        parts = [_NONE]
        for a, r in _sides(anchors, rows):
            best = _Best(len(a.row) * n_positive, k)
            top = np.full((len(a.row), n_positive), -np.inf)
            best.floor[:] = np.inf
            floor = best.floor.reshape(len(a.row), n_positive)
            for i, scores in enumerate(anchors["positive_scores"].take(pa.array(a.at)).to_pylist()):
                for place, score in enumerate(scores):
                    floor[i, place], top[i, place] = -(-low * score // 100), high * score // 100
            for ai in _tiles(len(a.row), 512):
                most = top[ai].max(1)
                for ri in _tiles(len(r.row), 2048, 256):
                    apart = a.label[ai][:, None] != r.label[ri][None, :]
                    i, j, score = _scored(a, r, ai, ri, floor[ai].min(1), most, apart)
                    for place in range(n_positive):
                        fits = score <= top[ai[i], place]
                        best.add(ai[i[fits]] * n_positive + place, score[fits], ri[j[fits]], r)
            parts.append(_result(a, r, best, n_positive))
        return pa.concat_tables(parts)

    return run


def _met(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, run) -> DataFrame:
    """``run`` on every pair of a block of anchors and a block of rows."""
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = ["anchor_block", "row_block"]
    tasks = min(n_anchor_blocks * n_row_blocks, 10_000)
    left = anchors.select("*", block(n_anchor_blocks).alias(pair[0]), every(n_row_blocks).alias(pair[1]))
    # New names for the columns: both sides come from one table, and a cogroup can't tell them apart.
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns], every(n_anchor_blocks).alias(pair[0]), block(n_row_blocks).alias(pair[1]))
    left, right = left.repartition(tasks, *pair), right.repartition(tasks, *pair)
    return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(run, _FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    n_positive: int = 5,
    n_negative: int = 3,
    low: int = 50,
    high: int = 95,
    anchor_block: int = 4096,
    row_block: int = 8192,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all exact.

    Components become floor(256 * x). Scores are integer inner products; higher ones come first, ties
    by smaller id (null ids last). Positives are an anchor's first ``n_positive`` other rows of its label;
    each gets the first ``n_negative`` rows of other labels whose score lies from ``low`` to ``high``
    percent of the positive's. Anchors without positives, and positives without such rows, return
    nothing. An anchor block meets every row block, so work grows with anchors times rows: rows move once per
    ``anchor_block`` anchors, anchors once per ``row_block`` rows.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do
    vectors so long that their scores leave 64 bits (sum of squares of 2**55 or more). Vectors of
    different lengths have no score; empty ones score 0 with each other. Repeated rows and ids are rows
    of their own. Other columns change nothing. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.stage(summarised(vectors, key, label, vector, is_anchor), "vectors")
        n = rows.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors")).first()
        blocks = max(-(-n["anchors"] // anchor_block), 1), max(-(-n["rows"] // row_block), 1)
        anchors, candidates = rows.where("is_anchor").drop("is_anchor"), rows.drop("is_anchor")
        found = _first(_met(anchors, candidates, *blocks, _positives(n_positive)), ["anchor"], n_positive)
        positives = scratch.stage(
            found.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
            "positives",
        )
        wanted = positives.groupBy(F.col("anchor").alias("row")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positive_scores")
        )
        run = _negatives(n_positive, n_negative, low, high)
        found = _first(_met(anchors.join(wanted, "row"), candidates, *blocks, run), ["anchor", "place"], n_negative)
        names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        return stage(
            found.join(positives, ["anchor", "place"]).join(names, "anchor").select(
                "anchor_id",
                "positive_id",
                "rank",
                F.col("id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            ),
            "hard-negatives",
        )
