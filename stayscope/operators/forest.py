"""Random forest whose trees are grown a task each.

Spark's own forest sends the split statistics of every group of nodes through a shuffle, which costs far more than
the sums themselves while a task can hold the rows. Here rows are binned once and written as files; a task reads
them and grows whole trees, level by level, without exchanges. The method is Spark's: bins by quantiles, Poisson
draws of rows, a draw of features for each node, splits by the drop of variance, means in leaves. More rows than
a task holds go to Spark's forest.
"""

from __future__ import annotations

import json
import math
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.ml import Model
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.operators.boosting import _as_array, _table, bin_edges
from stayscope.sources.files import qualified, reading, writing
from stayscope.sources.staging import Scratch, shared_folder, stage

#: Binned values (rows times features) that a task may hold; a tree's own rows take up to 60 bytes each beside them.
TASK_CELLS = 130_000_000
#: Nodes and rows worked on at a time: their sums stay in the processor's cache.
NODES, BLOCK_ROWS = 256, 131_072
#: Tasks for each core, so that none waits long for the last ones.
TASKS_PER_CORE = 4


@dataclass
class Draws:
    """How trees grow: sizes, draws and the rows that a leaf needs."""

    depth: int
    features: int
    row_share: float
    min_rows: int
    min_gain: float
    seed: int


@dataclass
class Grown:
    """A tree in order of growth: feature of each node (-1: leaf), bin of each split, value of each leaf.

    The splits' children follow in the same order, two by two.
    """

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """(where each node leads, its value): first child, feature and bin in one number; leaves lead to themselves."""
        split = self.feature >= 0
        child, feature, at = np.arange(len(split)), np.maximum(self.feature, 0).astype(np.int64), np.full(len(split), 255)
        child[split], at[split] = 1 + 2 * np.arange(split.sum()), self.bin
        value = np.zeros(len(split))
        value[~split] = self.value
        return child << 24 | feature << 8 | at, value


def grown_tree(bins: np.ndarray, y: np.ndarray, width: int, draws: Draws, tree: int) -> Grown:
    """One tree over rows of bins (each below ``width``) and labels."""
    rng, features = np.random.default_rng([draws.seed, tree]), bins.shape[1]
    weight = rng.poisson(draws.row_share, len(y)).astype(np.uint8)
    own = np.flatnonzero(weight)
    # Labels around their mean: differences of sums keep their digits.
    middle, weight = float(y.mean()) if len(y) else 0.0, weight[own].astype(float)
    sums = np.empty(len(own), complex)  # sum and count side by side, added in one step
    sums.real, sums.imag = weight * (y[own] - middle), weight
    rows, counts, gains = np.take(bins, own, axis=0), np.array([len(own)]), np.zeros(features)
    kinds, ats, values = [], [], []
    for level in range(draws.depth + 1):
        parts = []
        ends = np.cumsum(counts)
        for first in range(0, len(counts), NODES):
            begin, end = (int(ends[first - 1]) if first else 0), int(ends[min(first + NODES, len(counts)) - 1])
            chunk = counts[first : first + NODES]
            part = _split(rows[begin:end], sums[begin:end], chunk, width, draws, rng, level == draws.depth)
            kinds.append(part[0])
            ats.append(part[1])
            values.append(part[2] + middle)
            gains += part[3]
            parts.append(part[4:])
        if not any(len(p[2]) for p in parts):
            break
        rows, sums, counts = (np.concatenate(p) for p in zip(*parts))
    return Grown(np.concatenate(kinds), np.concatenate(ats), np.concatenate(values), gains)


def _split(rows, sums, counts, width: int, draws: Draws, rng, last: bool) -> tuple:
    """Splits of neighbouring nodes of a level, whose rows lie one node after the other.

    Returns feature of each node, bin of each split, value of each leaf, gains per feature, and rows, sums and
    row counts of the children.
    """
    nodes, features = len(counts), rows.shape[1]
    ends = np.cumsum(counts)
    total = np.add.reduceat(sums, ends - counts) if len(sums) else np.zeros(nodes, complex)
    feature, at, gain = np.full(nodes, -1, np.int16), np.zeros(nodes, np.uint8), np.zeros(nodes)
    open_ = np.flatnonzero(total.imag >= 2 * draws.min_rows) if not last else np.empty(0, int)
    if len(open_):
        where = np.full(nodes, -1)
        where[open_] = np.arange(len(open_))
        place = np.repeat(where, counts)
        if len(open_) < nodes:
            keep = np.flatnonzero(place >= 0)
            rows, sums, place = np.take(rows, keep, axis=0), sums[keep], place[keep]
        found = _best(_histograms(rows, sums, place, len(open_), width), total[open_], draws, rng)
        feature[open_], at[open_], gain[open_] = found
    split = feature >= 0
    gains = np.bincount(feature[split], gain[split], features)
    value = (total.real / np.maximum(total.imag, 1))[~split]
    out = feature, at[split], value, gains
    if not split.any():
        return *out, rows[:0], sums[:0], counts[:0]
    order = np.cumsum(split) - 1
    node = open_[place]
    moved = np.flatnonzero(split[node])
    if len(moved) < len(node):
        rows, sums, node = np.take(rows, moved, axis=0), sums[moved], node[moved]
    cell = rows.ravel()[np.arange(0, rows.size, features) + feature[node]]
    child = (2 * order[node] + (cell > at[node])).astype(np.uint16)
    turn = np.argsort(child, kind="stable")
    return *out, np.take(rows, turn, axis=0), sums[turn], np.bincount(child, minlength=2 * int(split.sum()))


def _histograms(rows, sums, place, nodes: int, width: int) -> np.ndarray:
    """Sums by node, feature and bin."""
    features = rows.shape[1]
    table = np.zeros(nodes * features * width, complex)
    for begin in range(0, len(rows), BLOCK_ROWS):
        block = slice(begin, begin + BLOCK_ROWS)
        start, own = place[block] * (features * width), sums[block]
        slot = np.empty_like(start)
        for f in range(features):
            np.add(start, rows[block, f], out=slot)
            np.add.at(table[f * width :], slot, own)
    return table.reshape(nodes, features, width)


def _best(table: np.ndarray, total: np.ndarray, draws: Draws, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, gain) of each node's best split among the features drawn for it; feature -1 if none gains."""
    nodes, features, width = table.shape
    # Of the last bin nothing lies to the right.
    left = np.cumsum(table[:, :, :-1], axis=2)
    right = total[:, None, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left.real**2 / left.imag + right.real**2 / right.imag
    score[(left.imag < draws.min_rows) | (right.imag < draws.min_rows)] = -np.inf
    if draws.features < features:
        drawn = np.argpartition(rng.random((nodes, features)), draws.features - 1, axis=1)
        score[np.arange(nodes)[:, None], drawn[:, draws.features :]] = -np.inf
    score = score.reshape(nodes, -1)
    best = np.argmax(score, axis=1)
    before = total.real**2 / total.imag
    gain = score[np.arange(nodes), best] - before
    # A drop of variance that rounding alone may give is none.
    gains = (gain > 1e-12 * np.maximum(before, 1e-9)) & (gain >= draws.min_gain * total.imag)
    feature, at = np.divmod(best, width - 1)
    return np.where(gains, feature, -1), at, np.where(gains, gain, 0.0)


# ---- Rows in files ----


def _binned(edges: list[list[float]], folder: str):
    """Task function: writes the bins and labels of its rows; returns the file and the lowest value of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full(len(e), np.inf) for e in edges]
        with writing(folder, ".bins") as (path, out):
            for batch in batches:
                x = _table(batch["x"], len(edges))
                if not np.isfinite(x).all():
                    raise ValueError("features must not be NaN or infinite")
                found = np.empty(x.shape, np.uint8)
                for i, e in enumerate(edges):
                    found[:, i] = np.minimum(np.searchsorted(e, x[:, i]), len(e) - 1)
                    np.minimum.at(low[i], found[:, i], x[:, i])
                out.write(np.int64(len(x)).tobytes())
                out.write(found.tobytes())
                out.write(batch["y"].to_numpy().astype(np.float64).tobytes())
        yield pa.RecordBatch.from_pydict({"path": [path], "low": [json.dumps([v.tolist() for v in low])]})

    return run


def _held(paths: list[str], features: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and labels of all rows, in files of a folder of the task."""
    rows = 0
    with open(f"{folder}/bins", "wb") as bins, open(f"{folder}/y", "wb") as y:
        for path in paths:
            with reading(path) as held:
                while head := held.read(8):
                    n = int(np.frombuffer(head, np.int64)[0])
                    bins.write(held.read(n * features))
                    y.write(held.read(n * 8))
                    rows += n
    return np.memmap(f"{folder}/bins", np.uint8, "r", shape=(rows, features)), np.memmap(f"{folder}/y", np.float64, "r", shape=(rows,))


_TREE = "tree int, feature binary, bin binary, value binary, gains binary"


def _growing(paths: list[str], width: int, features: int, draws: Draws):
    """Task function: grows the trees of the numbers it gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            bins, y = _held(paths, features, folder)
            for batch in batches:
                for tree in batch["id"].to_pylist():
                    t = grown_tree(bins, y, width, draws, tree)
                    held = {k: [v.tobytes()] for k, v in (("feature", t.feature), ("bin", t.bin), ("value", t.value), ("gains", t.gains))}
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), *map(pa.array, held.values())], ["tree", *held])

    return run


def _tree_rows(paths: list[str]) -> list[dict]:
    rows = []
    for path in paths:
        with reading(path) as held:
            rows += pq.read_table(held, columns=["tree", "feature", "bin", "value", "gains"]).to_pylist()
    return sorted(rows, key=lambda r: r["tree"])


def _grown(row) -> Grown:
    kinds = ("feature", np.int16), ("bin", np.uint8), ("value", np.float64), ("gains", np.float64)
    return Grown(*[np.frombuffer(row[k], kind) for k, kind in kinds])


# ---- Stages ----


class GrownForest(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """Fitted trees, a row of ``trees`` each; saved and loaded like any other stage."""

    content = Param(Params._dummy(), "content", "bounds between the bins of each feature, and depth (JSON)", TypeConverters.toString)

    def __init__(self, content: str = "{}", trees: DataFrame | None = None):
        super().__init__()
        self._set(content=content)
        self.trees = trees

    def _read(self) -> tuple[list[list[float]], int]:
        held = json.loads(self.getOrDefault(self.content))
        return held["bounds"], held["depth"]

    @property
    def featureImportances(self) -> DenseVector:
        """Drop of squared errors per feature as shares of a tree's, over all trees."""
        total = np.zeros(len(self._read()[0]))
        for r in self.trees.select("tree", "gains").orderBy("tree").collect():
            gains = np.frombuffer(r["gains"])
            total += gains / gains.sum() if gains.sum() > 0 else 0.0
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        (bounds, depth), rows = self._read(), self._sent(dataset.sparkSession)

        @F.arrow_udf("double")
        def predict(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
            steps = [_grown(r).steps() for r in rows()]
            for x in lists:
                yield pa.array(predicted(steps, binned(_table(x, len(bounds)), bounds), depth))

        return dataset.withColumn(self.getPredictionCol(), predict(_as_array(dataset, self.getFeaturesCol())))

    def _sent(self, spark: SparkSession) -> Callable[[], list[dict]]:
        """Function that gives a task the trees: from their files, or from the driver if tasks cannot open that store."""
        try:
            return partial(_tree_rows, [qualified(spark, path) for path in self.trees.inputFiles()])
        except ValueError:
            sent = spark.sparkContext.broadcast([r.asDict() for r in self.trees.orderBy("tree").collect()])
            return lambda: sent.value

    def write(self) -> _ForestWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> _ForestReader:
        return _ForestReader(cls)


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.trees.write.parquet(f"{path}/trees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> GrownForest:
        model = super().load(path)
        model.trees = self.sparkSession.read.schema(_TREE).parquet(f"{path}/trees")
        return model


def binned(x: np.ndarray, bounds: list[list[float]]) -> np.ndarray:
    """Bins of values; a value on a bound belongs to the bin below it."""
    return np.stack([np.searchsorted(b, x[:, i]) for i, b in enumerate(bounds)], axis=1).astype(np.uint8)


def predicted(steps: list[tuple[np.ndarray, np.ndarray]], bins: np.ndarray, depth: int) -> np.ndarray:
    """Mean of the trees' values for each row."""
    cells, first, total = bins.ravel(), np.arange(0, bins.size, bins.shape[1]), np.zeros(len(bins))
    for lead, value in steps:
        node = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            step = lead[node]
            node = (step >> 24) + (cells[first + (step >> 8 & 0xFFFF)] > (step & 255))
        total += value[node]
    return total / len(steps)


def _drawn_features(strategy: str, trees: int, features: int) -> int:
    """How many features a node draws, by Spark's names, counts and shares."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "onethird"
    named = {"all": features, "onethird": features / 3, "sqrt": math.sqrt(features), "log2": max(math.log2(features), 1)}
    count = named[strategy] if strategy in named else int(strategy) if strategy.isdigit() else float(strategy) * features
    return min(math.ceil(count), features)


class SharedRowsForest(RandomForestRegressor):
    """Spark's random forest, grown a task per tree as long as a task can hold the binned rows.

    Weighted rows, draws without replacement, nominal features and more rows are left to Spark's own.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        if not self._plain(dataset):
            return super()._fit(dataset)
        spark = dataset.sparkSession
        y = F.col(self.getLabelCol()).cast("double")
        bad = y.isNull() | F.isnan(y)
        label = F.when(bad, F.raise_error(F.lit("labels must not be null or NaN"))).otherwise(y)
        x = _as_array(dataset, self.getFeaturesCol()).cast("array<double>")
        shared_folder(spark)
        with Scratch(spark) as scratch:
            rows = scratch.stage(dataset.select(label.alias("y"), x.alias("x")), "training")
            first = rows.select(F.size("x")).first()
            if first is None or rows.count() * first[0] > TASK_CELLS:
                return super()._fit(dataset)
            return self._grow(rows, first[0], qualified(spark, scratch.path("bins")))

    def _plain(self, dataset: DataFrame) -> bool:
        attributes = dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {})
        weighted = self.isDefined("weightCol") and self.getWeightCol()
        return not weighted and self.getBootstrap() and "nominal" not in attributes and self.getMaxBins() <= 255

    def _grow(self, rows: DataFrame, features: int, folder: str) -> GrownForest:
        spark, trees, depth = rows.sparkSession, self.getNumTrees(), self.getMaxDepth()
        edges = bin_edges(rows, features, self.getMaxBins())
        files = rows.select("y", "x").mapInArrow(_binned(edges, folder), "path string, low string").collect()
        low = [np.min(own, axis=0) for own in zip(*[json.loads(r["low"]) for r in files])]
        # Bounds lie midway between neighbouring values.
        bounds = [[(a + b) / 2 for a, b in zip(e, v[1:])] for e, v in zip(edges, low)]
        drawn = _drawn_features(self.getFeatureSubsetStrategy(), trees, features)
        draws = Draws(depth, drawn, self.getSubsamplingRate(), self.getMinInstancesPerNode(), self.getMinInfoGain(), self.getSeed())
        task = _growing([r["path"] for r in files], max(2, *map(len, edges)), features, draws)
        parts = min(trees, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
        grown = stage(spark.range(0, trees, 1, parts).mapInArrow(task, _TREE), "forest")
        model = GrownForest(json.dumps({"bounds": bounds, "depth": depth}), grown)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
