"""Gradient boosting with leaf penalties: second-order trees over binned columns.

All rounds are one barrier stage. Its tasks keep their binned rows and gradients in files of their own. At every
level of a tree, for all models that grow together (the folds of a cross-validation), they add up gradients and row
counts per node, feature and bin, exchange these tables, whose size does not depend on the rows, through files of the shared
folder, and pick the same splits. Of the two leaves of a split only the one of fewer rows is added up; the other has the rest of
their node's sums (small tables add up both, as rounding alone settles which of equal splits wins). L1, L2 and a cost per leaf enter the gain of splits and the leaf values; rows and columns are
drawn anew for each tree by hashes. A lost task costs the stage.
"""

from __future__ import annotations

import base64
import json
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, suppress
from dataclasses import asdict, dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.side_by_side import side_by_side
from stayscope.sources.files import Exchange, qualified
from stayscope.sources.staging import Scratch

BINS = 256
#: Values that the bins of columns summed together may take.
JOINT = 1024
#: Rows of a growing model that are worth a task, the tasks that exchange sums at most, rows worked on at a
#: time, and bytes of sums that reach a task in one exchange.
TASK_ROWS, MOST_TASKS, BLOCK_ROWS, EXCHANGED = 1_000_000, 32, 65536, 8_000_000


def shrunk(gradient, l1: float):
    """The gradient sum after an L1 penalty."""
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


@dataclass
class Tree:
    """Nodes in order of growth; a leaf has feature -1. Rows go left when their value is at most the threshold."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int, threshold: float, gain: float, values: tuple[float, float]) -> int:
        """Give a leaf two leaves; returns the left one, the right one follows it."""
        left = len(self.feature)
        self.feature[node], self.bin[node], self.threshold[node] = feature, at, threshold
        self.left[node], self.gain[node] = left, gain
        for value in values:
            self.feature.append(-1)
            self.bin.append(0)
            self.threshold.append(0.0)
            self.left.append(0)
            self.value.append(value)
            self.gain.append(0.0)
        return left

    def steps(self) -> np.ndarray:
        """Where each node leads: left leaf, feature and bin in one number; leaves lead to themselves."""
        feature, node = np.array(self.feature), np.arange(len(self.feature))
        split = feature >= 0
        return np.where(split, self.left, node) << 24 | np.maximum(feature, 0) << 8 | np.where(split, self.bin, BINS - 1)


def added(trees: list[Tree], columns: np.ndarray) -> np.ndarray:
    """Sum of the trees' values for each row of feature values."""
    cells, first, total = columns.ravel(), np.arange(0, columns.size, columns.shape[1]), np.zeros(len(columns))
    for t in trees:
        # Leaves lead to themselves, as no value lies above their threshold.
        feature, own = np.array(t.feature), np.arange(len(t.feature))
        split = feature >= 0
        left, cell, threshold = np.where(split, t.left, own), np.maximum(feature, 0), np.where(split, t.threshold, np.inf)
        node, before = np.zeros(len(columns), np.int64), None
        while before is None or (node != before).any():
            before = node
            node = left[before] + (cells[first + cell[before]] > threshold[before])
        total += np.array(t.value)[node]
    return total


def bin_edges(rows: DataFrame, features: int, bins: int = BINS) -> list[list[float]]:
    """Upper edges of each feature's bins: all distinct values if ``bins`` hold them, else quantiles.

    At most ``bins`` numbers per feature reach the driver.
    """
    x = [F.col("x")[i] for i in range(features)]
    counts = rows.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(x)]).first()
    shares = [(k + 1) / bins for k in range(bins)]
    few = [counts[f"n{i}"] <= bins * 0.9 for i in range(features)]
    edges = rows.agg(
        *[
            (F.collect_set(c) if is_few else F.percentile_approx(c, shares, 100 * bins)).alias(f"e{i}")
            for i, (c, is_few) in enumerate(zip(x, few))
        ]
    ).first()
    return [sorted(set(edges[f"e{i}"] or [0.0]))[-bins:] for i in range(features)]


def _table(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _drawn(rows: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether each row is drawn for a tree, by a hash of its number."""
    h = (rows.astype(np.uint64) + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53) < share


@dataclass
class _Part:
    """One of the models that grow together: it learns from all folds but one, or from all."""

    held_out: int | None
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: The tree that grows, and its nodes that may split.
    tree: Tree | None = None
    active: list[int] = field(default_factory=list)
    #: The active nodes whose sums are added up from rows (all if there are none), and the sums of all nodes a level above.
    lesser: list[int] = field(default_factory=list)
    above: np.ndarray | None = None

    def begin(self) -> None:
        self.tree, self.active, self.lesser, self.above = Tree(), [0], [], None

    @property
    def summed(self) -> list[int]:
        return self.lesser or self.active


class _Rows:
    """A task's rows in files of ``folder``: row number, label, fold and bins, and each model's prediction and node."""

    def __init__(self, batches: Iterator[pa.RecordBatch], edges: list[list[float]], bases: list[float], folder: str):
        self._folder, self.n, sorted_edges = folder, 0, [np.array(e) for e in edges]
        with ExitStack() as files:
            row, y, fold, bins, *by_column = [
                files.enter_context(open(f"{folder}/{name}", "wb"))
                for name in ("row", "y", "fold", "bins", *(f"bins{i}" for i in range(len(edges))))
            ]
            for batch in batches:
                x = _table(batch["x"], len(edges))
                found = np.empty(x.shape, np.uint8)
                for i, e in enumerate(sorted_edges):
                    found[:, i] = np.minimum(np.searchsorted(e, x[:, i]), len(e) - 1)
                    by_column[i].write(found[:, i].tobytes())
                self.n += len(x)
                bins.write(found.tobytes())
                row.write(batch["row"].to_numpy().astype(np.int64).tobytes())
                y.write(batch["y"].to_numpy().astype(np.float64).tobytes())
                fold.write(batch["fold"].to_numpy(zero_copy_only=False).astype(np.int32).tobytes())
        self.row, self.y, self.fold = self._file("row", np.int64), self._file("y", np.float64), self._file("fold", np.int32)
        self.bins = self._file("bins", np.uint8, len(edges))
        #: The same bins a column each: sums read whole columns, moves single cells of a row.
        self.by_column = [self._file(f"bins{i}", np.uint8) for i in range(len(edges))]
        self.joint = []
        if self.n > BLOCK_ROWS:
            self._join([len(e) for e in edges])
        self.margins = [self._file(f"margin{k}", np.float64) for k in range(len(bases))]
        self.nodes = [self._file(f"node{k}", np.int32) for k in range(len(bases))]
        self.drawn, self._draw = self._file("drawn", np.bool_), None
        for margins, base in zip(self.margins, bases):
            margins[:] = base

    def _join(self, sizes: list[int]) -> None:
        """Columns of few bins are summed together, by one number for the bins of all: (columns, their sizes, numbers)."""
        group, product = [], 1
        for i in [*np.argsort(sizes, kind="stable").tolist(), None]:
            if i is not None and product * sizes[i] <= JOINT:
                group.append(i)
                product *= sizes[i]
                continue
            if len(group) > 1:
                shape = [sizes[c] for c in group]
                numbers = self._file(f"joint{len(self.joint)}", np.uint16)
                for block in self.blocks():
                    numbers[block] = np.ravel_multi_index([self.by_column[c][block] for c in group], shape)
                self.joint.append((group, shape, numbers))
            group, product = [i], sizes[i] if i is not None else 1

    def _file(self, name: str, kind, width: int | None = None) -> np.ndarray:
        shape = (self.n,) if width is None else (self.n, width)
        if not self.n:
            return np.empty(shape, kind)
        mode = "r+" if name in ("row", "y", "fold") or name.startswith("bins") else "w+"
        return np.asarray(np.memmap(f"{self._folder}/{name}", kind, mode, shape=shape))

    def blocks(self) -> Iterator[slice]:
        for start in range(0, self.n, BLOCK_ROWS):
            yield slice(start, min(start + BLOCK_ROWS, self.n))

    def draw(self, seed: int, share: float) -> None:
        """Draw the rows of a tree, once for all models."""
        if self._draw != (seed, share):
            self._draw = seed, share
            for block in self.blocks():
                self.drawn[block] = _drawn(self.row[block], seed, share)

    def move(self, k: int, steps: np.ndarray, block: slice) -> np.ndarray:
        """Rows that stand on a node which has split go on to its leaves; returns where the rows stand."""
        node = self.nodes[k][block]
        if len(steps) > 1:
            bins, step = self.bins[block], np.take(steps, node, mode="clip")
            cell = np.arange(0, bins.size, bins.shape[1])
            cell += step >> 8 & 0xFFFF
            right = np.take(bins.ravel(), cell, mode="clip") > step.astype(np.uint8)
            step >>= 24
            np.add(step, right, out=node, casting="unsafe")
        return node

    def _read(self, columns: np.ndarray) -> list[tuple[list[int], list[int], np.ndarray, int]]:
        """What is summed for the drawn columns: (columns, their sizes, numbers, how many numbers there are)."""
        drawn, found = set(columns.tolist()), []
        for group, shape, numbers in self.joint:
            if len(drawn.intersection(group)) > 1:
                drawn -= set(group)
                found.append((group, shape, numbers, math.prod(shape)))
        return found + [([c], [BINS], self.by_column[c], BINS) for c in sorted(drawn)]

    def _apart(self, tables: list[np.ndarray], columns: np.ndarray, nodes: int) -> np.ndarray:
        """Sums by node, drawn column and bin from those of columns summed together."""
        out, place = np.zeros((nodes, len(columns), BINS), complex), {c: i for i, c in enumerate(columns.tolist())}
        for table, (group, shape, _, _) in zip(tables, self._read(columns)):
            table = table.reshape(nodes, *shape)
            for axis, c in enumerate(group, 1):
                if c in place:
                    out[:, place[c], : shape[axis - 1]] = table.sum(axis=tuple(a for a in range(1, len(shape) + 1) if a != axis))
        return out

    def sums(self, parts: list[_Part], columns: np.ndarray, seed: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and row counts of all nodes to be summed by place of the node, drawn column and bin."""
        self.draw(seed, share)
        found, read = [np.zeros((0, len(columns), BINS), complex)], [(c, w) for _, _, c, w in self._read(columns)]
        for k, p in enumerate(parts):
            if not p.active:
                continue
            nodes, steps = p.summed, p.tree.steps()
            where, tables = np.full(len(steps), -1), [np.zeros(len(nodes) * width, complex) for _, width in read]
            where[nodes] = np.arange(len(nodes))
            for block in self.blocks():
                place = where[self.move(k, steps, block)]
                keep = self.drawn[block] & (place >= 0)
                if p.held_out is not None:
                    keep &= self.fold[block] != p.held_out
                keep = np.flatnonzero(keep)
                # Gradient and count side by side are added in one step.
                place, own, slot = place[keep], np.empty(len(keep), complex), np.empty(len(keep), np.int64)
                own.real, own.imag = self.margins[k][block][keep] - self.y[block][keep], 1.0
                for (column, width), table in zip(read, tables):
                    # Clipping only spares the check of each place; all are within the block.
                    cell = np.take(column[block], keep, mode="clip")
                    np.add(place * width, cell, out=slot)
                    np.add.at(table, slot, own)
            found.append(self._apart(tables, columns, len(nodes)))
        all_sums = np.concatenate(found).ravel()
        return all_sums.real.copy(), all_sums.imag.astype(np.int64)

    def add(self, k: int, tree: Tree) -> None:
        """Add a grown tree's values to the predictions; the next tree starts at its root."""
        values, steps = np.array(tree.value), tree.steps()
        for block in self.blocks():
            self.margins[k][block] += values[self.move(k, steps, block)]
            self.nodes[k][block] = 0

    def errors(self, k: int, held_out: int | None) -> tuple[int, float]:
        """Rows and squared errors of the fold that a model left out."""
        n, total = 0, 0.0
        for block in self.blocks():
            own = self.fold[block] == (-1 if held_out is None else held_out)
            n, total = n + int(own.sum()), total + float(((self.y[block] - self.margins[k][block])[own] ** 2).sum())
        return n, total


def _over_tasks(tasks: int, folder: str | None) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Function that adds up tables of gradients and counts over the tasks of a barrier stage.

    Every task adds them in the same order, so all hold the same sums. Long tables go in parts. They go through files of
    ``folder``: Spark's barrier lets a task wait up to a second each time. Without a folder that
    tasks can open they go through the barrier.
    """
    if tasks == 1:
        return lambda g, n: (g, n)
    context, step = BarrierTaskContext.get(), max(EXCHANGED // (22 * tasks), 1)
    if folder:
        # Each attempt of the stage has a name of its own, so no file of a lost one is read.
        attempt = context.allGather(uuid.uuid4().hex)[0]
        swap = Exchange(f"{folder}/{attempt}", context.partitionId(), tasks).swap
    else:

        def swap(own: bytes) -> Iterator[bytes]:
            return map(base64.b64decode, context.allGather(base64.b64encode(own).decode()))

    def add(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        all_g, all_n = np.zeros(len(g)), np.zeros(len(n), np.int64)
        for first in range(0, len(g), step):
            part_g, part_n = g[first : first + step], n[first : first + step]
            slot, size = np.flatnonzero(part_n), len(part_n)
            if len(slot) * 16 < size * 12:
                own = slot.astype("<u4").tobytes() + part_n[slot].astype("<u4").tobytes() + part_g[slot].astype("<f8").tobytes()
            else:
                own = part_n.astype("<u4").tobytes() + part_g.astype("<f8").tobytes()
            for held in swap(own):
                if len(held) == 12 * size:
                    at, n_of, g_of = slice(first, first + size), np.frombuffer(held, "<u4", size), np.frombuffer(held, "<f8", size, 4 * size)
                else:
                    few = len(held) // 16
                    at = np.frombuffer(held, "<u4", few).astype(np.int64) + first
                    n_of, g_of = np.frombuffer(held, "<u4", few, 4 * few), np.frombuffer(held, "<f8", few, 8 * few)
                all_n[at] += n_of
                all_g[at] += g_of
        return all_g, all_n

    return add


_GROWN = "part int, n long, sse double, trees string"


@dataclass
class Penalties:
    l1: float = 0.0
    l2: float = 1.0
    #: What every further leaf must gain.
    leaf: float = 0.0
    #: Rows that each side of a split must have.
    min_rows: float = 1.0

    def score(self, g, n):
        return shrunk(g, self.l1) ** 2 / (n + self.l2)

    def value(self, g: float, n: float) -> float:
        return float(-shrunk(g, self.l1) / (n + self.l2)) if n + self.l2 > 0 else 0.0

    def best_splits(self, g: np.ndarray, n: np.ndarray) -> list[tuple[float, int, int, float, float] | None]:
        """For each node (gain, place of the column, bin, g and n of the left side) over tables by node, column and bin; None if none gains.

        Equal gains: the first column, then the lowest bin.
        """
        gl, nl = np.cumsum(g, 2), np.cumsum(n, 2)
        total_g, total_n = gl[:, :, -1:], nl[:, :, -1:]
        gr, nr = total_g - gl, total_n - nl
        with np.errstate(divide="ignore", invalid="ignore"):
            before = self.score(total_g, total_n)
            gain = (self.score(gl, nl) + self.score(gr, nr) - before) / 2 - self.leaf
        gain[(nl < max(self.min_rows, 1)) | (nr < max(self.min_rows, 1)) | (n == 0)] = -np.inf
        out = []
        for node, at in enumerate(np.argmax(gain.reshape(len(g), -1), axis=1)):
            c, b = divmod(int(at), g.shape[2])
            if gain[node, c, b] > 1e-9 * max(abs(float(before[node, c, 0])), 1e-9):
                out.append((float(gain[node, c, b]), c, b, float(gl[node, c, b]), float(nl[node, c, b])))
            else:
                out.append(None)
        return out


@dataclass
class Growth:
    """How trees grow: sizes, penalties and draws."""

    rounds: int
    step: float
    depth: int
    penalties: Penalties
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 0

    def _split(self, parts: list[_Part], g: np.ndarray, n: np.ndarray, edges: list[list[float]], columns: np.ndarray, halve: bool) -> None:
        """Split the active nodes by their sums; their new leaves are the next active ones. ``halve``: one of two is summed."""
        shape, place = (len(columns), BINS), 0
        all_g, all_n = g.reshape(-1, *shape), n.reshape(-1, *shape)
        for p in parts:
            if not p.active:
                continue
            g, n = (t[place : place + len(p.summed)].astype(float) for t in (all_g, all_n))
            place += len(p.summed)
            if p.lesser:
                # Leaves stand in pairs; the one that was not summed has the rest.
                first, (above_g, above_n) = np.array(p.lesser) == np.array(p.active[::2]), p.above
                pick = first[:, None, None, None]
                g, n = (np.where(pick, np.stack([t, u - t], 1), np.stack([u - t, t], 1)).reshape(-1, *shape) for t, u in ((g, above_g), (n, above_n)))
                g[n == 0] = 0.0
            following, lesser, split = [], [], []
            for at, (node, best) in enumerate(zip(p.active, self.penalties.best_splits(g, n))):
                node_g, node_n = float(np.cumsum(g[at, 0])[-1]), float(n[at, 0].sum())
                if node == 0:
                    p.tree.value[0] = self.step * self.penalties.value(node_g, node_n)
                if best is not None:
                    gain, c, b, left_g, left_n = best
                    f = int(columns[c])
                    values = self.penalties.value(left_g, left_n), self.penalties.value(node_g - left_g, node_n - left_n)
                    left = p.tree.split(node, f, b, edges[f][b], gain, tuple(self.step * v for v in values))
                    following += [left, left + 1]
                    lesser.append(left + (2 * left_n > node_n))
                    split.append(at)
            p.active, p.lesser, p.above = following, lesser if halve else [], (g[split], n[split])

    def _task(self, parts: list[_Part], edges: list[list[float]], tasks: int, shared: str | None = None):
        """Task function: grows all models with the other tasks, by way of the folder ``shared``.

        Returns rows and squared errors of the folds left out and, from the first task, the trees of a
        model that leaves none out.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with tempfile.TemporaryDirectory() as folder:
                rows, over_tasks = _Rows(batches, edges, [p.base for p in parts], folder), _over_tasks(tasks, shared)
                rng, halve = np.random.default_rng(self.seed), tasks > 1 or rows.n > BLOCK_ROWS
                for k in range(self.rounds):
                    columns = np.sort(rng.permutation(len(edges))[: max(1, round(self.column_share * len(edges)))])
                    for p in parts:
                        p.begin()
                    for _ in range(self.depth):
                        g, n = rows.sums(parts, columns, self.seed * 1_000_003 + k, self.row_share)
                        self._split(parts, *over_tasks(g, n), edges, columns, halve)
                        if not any(p.active for p in parts):
                            break
                    for at, p in enumerate(parts):
                        rows.add(at, p.tree)
                        if p.held_out is None:
                            p.trees.append(p.tree)
                found = [rows.errors(at, p.held_out) for at, p in enumerate(parts)]
            first = TaskContext.get().partitionId() == 0
            trees = [json.dumps([asdict(t) for t in p.trees]) if first else None for p in parts]
            columns = pa.array(range(len(parts)), pa.int32()), pa.array([n for n, _ in found]), pa.array([e for _, e in found]), pa.array(trees, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns), ["part", "n", "sse", "trees"])

        return run

    def grow(self, rows: DataFrame, edges: list[list[float]], held_out: list[int | None], shared: str | None = None) -> list[tuple[float, list[Tree], float | None]]:
        """Models of (row, y, fold, x) rows, one for each fold left out, all from the same passes.

        Returns each one's first prediction, its trees if it leaves no fold out, and its RMSE on the fold
        that it leaves out. Models of few rows take a task each, without exchanges. The tasks of larger ones run at
        the same time, so there are no more than the cluster has cores; they exchange sums in the folder ``shared``.
        """
        means = rows.agg(F.count("*"), *[F.avg(F.when(F.lit(k is None) | (F.col("fold") != (k or 0)), F.col("y"))) for k in held_out]).first()
        parts = [_Part(k, base=m or 0.0) for k, m in zip(held_out, means[1:])]
        own_rows, cores = rows.select("row", "y", "fold", "x"), rows.sparkSession.sparkContext.defaultParallelism
        if means[0] <= TASK_ROWS:
            # A task for each model, side by side: none has to wait for the others' sums.
            def alone(p: _Part) -> list:
                return own_rows.repartition(1).mapInArrow(self._task([p], edges, 1), _GROWN).collect()

            found = side_by_side(rows.sparkSession, [partial(alone, p) for p in parts])
            grown = [{**r.asDict(), "part": at} for at, own in enumerate(found) for r in own]
        else:
            tasks = max(min(math.ceil(means[0] * len(parts) / TASK_ROWS), MOST_TASKS, cores), 1)
            grown = own_rows.repartition(tasks).mapInArrow(self._task(parts, edges, tasks, shared), _GROWN, barrier=tasks > 1).collect()
        out = []
        for at, p in enumerate(parts):
            own = [r for r in grown if r["part"] == at]
            n, trees = sum(r["n"] for r in own), next(r["trees"] for r in own if r["trees"] is not None)
            out.append((p.base, [Tree(**t) for t in json.loads(trees)], math.sqrt(sum(r["sse"] for r in own) / n) if n else None))
        return out


def _opened(scratch: Scratch) -> str | None:
    """The folder for exchanges, if its store is one that tasks can open."""
    with suppress(ValueError):
        return qualified(scratch.spark, scratch.path("sums"))


def _as_array(dataset: DataFrame, column: str) -> Column:
    """Features as an array, from a vector or an array."""
    is_vector = isinstance(dataset.schema[column].dataType, VectorUDT)
    return vector_to_array(F.col(column)) if is_vector else F.col(column)


class BoostedTrees(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; saved and loaded like any other stage."""

    content = Param(Params._dummy(), "content", "first prediction, trees and number of features (JSON)", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", predictionCol: str = "prediction", content: str = "{}"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _read(self) -> tuple[float, list[Tree], int]:
        held = json.loads(self.getOrDefault(self.content))
        return held["base"], [Tree(**t) for t in held["trees"]], held["features"]

    @property
    def trees(self) -> list[Tree]:
        return self._read()[1]

    @property
    def featureImportances(self) -> DenseVector:
        """Gain per feature, as shares of all gain."""
        _, trees, features = self._read()
        gains = np.zeros(features)
        for t in trees:
            for f, gain in zip(t.feature, t.gain):
                if f >= 0:
                    gains[f] += gain
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, trees, features = self._read()

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(base + added(trees, _table(x, features)))

        return dataset.withColumn(self.getPredictionCol(), predict(_as_array(dataset, self.getFeaturesCol())))


class PenalisedBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Boosting for squared error with L1, L2 and per-leaf penalties.

    Rows without a label are left out; an empty table gives a model that predicts 0. Rows are
    numbered for the draws, so repeated rows are drawn independently.
    """

    def __init__(
        self,
        rounds: int = 500,
        step: float = 0.02,
        depth: int = 5,
        penalties: Penalties | None = None,
        row_share: float = 1.0,
        column_share: float = 1.0,
        seed: int = 0,
        labelCol: str = "price",
        featuresCol: str = "features",
    ):
        super().__init__()
        self.growth = Growth(rounds, step, depth, penalties or Penalties(), row_share, column_share, seed)
        self._set(labelCol=labelCol, featuresCol=featuresCol)

    def _rows(self, dataset: DataFrame, fold, scratch: Scratch) -> tuple[DataFrame, list[list[float]]]:
        """Training rows, written, and the edges of their features' bins."""
        x, y = _as_array(dataset, self.getFeaturesCol()), F.col(self.getLabelCol())
        rows = dataset.where(y.isNotNull()).select(
            F.monotonically_increasing_id().alias("row"), y.cast("double").alias("y"), fold.cast("int").alias("fold"), x.cast("array<double>").alias("x")
        )
        rows = scratch.stage(rows, "training")
        first = rows.select(F.size("x")).first()
        return rows, bin_edges(rows, first[0]) if first else []

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        base, trees = 0.0, []
        with Scratch(dataset.sparkSession) as scratch:
            rows, edges = self._rows(dataset, F.lit(0), scratch)
            if edges:
                ((base, trees, _),) = self.growth.grow(rows, edges, [None], _opened(scratch))
        content = json.dumps({"base": base, "features": len(edges), "trees": [asdict(t) for t in trees]})
        return BoostedTrees(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(), content=content)

    def fold_errors(self, dataset: DataFrame, fold: str, folds: int) -> list[tuple[int, float | None]]:
        """(fold, RMSE) of models that each leave a fold out; all grow from the same passes.

        ``dataset`` is preprocessed. A fold without rows has no error.
        """
        with Scratch(dataset.sparkSession) as scratch:
            rows, edges = self._rows(dataset, F.col(fold), scratch)
            if not edges:
                return [(k, None) for k in range(folds)]
            grown = self.growth.grow(rows, edges, list(range(folds)), _opened(scratch))
        return [(k, error) for k, (_, _, error) in enumerate(grown)]
