"""Regression forests whose trees grow in tasks and stay in files.

Rows are cut into bins once. A task takes all binned rows, some 30 bytes each, and grows its share of the trees, each over
its own bootstrap; a tree is a row of a stored table as soon as it is grown. The driver sees cuts and counts, never a tree:
scoring meets blocks of rows with chunks of trees and adds up what the chunks say.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.plans.boosting import PACKED_ROWS, columns, quantile_cuts, varied_features
from hourgrid.plans.staging import staged
from hourgrid.session import scratch_dir

# Tasks of a fit for each of its cores, counts of a level held at once, bytes of the trees and rows of a tile.
WAVES, CELLS, CHUNK_BYTES, PART_ROWS = 3, 1 << 18, 1 << 25, 1 << 18
NODE_BYTES = 15
TREES = "tree int, nodes int, feature binary, cut binary, left binary, value binary"
SUBSETS = {
    "all": lambda n: n, "onethird": lambda n: -(-n // 3), "sqrt": lambda n: math.ceil(math.sqrt(n)),
    "log2": lambda n: max(1, math.ceil(math.log2(n))),
}


# -- Growth --------------------------------------------------------------------------------------

def _binned(frame: pd.DataFrame, cuts: list[np.ndarray]) -> np.ndarray:
    """A row of small numbers for each row, a number for each used feature; value <= cuts[b] has bin <= b."""
    out = np.empty((len(frame), len(cuts)), np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, frame[f"c{j}"].to_numpy())
    return out


def _packed(frames: Iterator[pd.DataFrame], cuts: list[np.ndarray], other: str) -> Iterator[pd.DataFrame]:
    """Blocks of bins next to the bytes of another column."""
    for frame in frames:
        for start in range(0, len(frame), PACKED_ROWS):
            part = frame.iloc[start:start + PACKED_ROWS]
            yield pd.DataFrame({"bins": [_binned(part, cuts).tobytes()], other: [part[other].to_numpy().tobytes()]})


def _splits(x, w, wy, size, place, width: int, tries: int, least: int, rng):
    """Per node, whose rows lie together: feature, cut, whether it splits, weight and sum of the left and the right side.

    Each node tries its own draw of all features; those with one value (place -1) split nothing.
    """
    ends, f = np.cumsum(size), x.shape[1]
    step, found = max(1, CELLS // (tries * width)), []
    for first in range(0, len(size), step):
        some = size[first:first + step]
        low, high, k = ends[first] - some[0], ends[first + len(some) - 1], len(some)
        drawn = place[rng.random((k, len(place))).argpartition(tries - 1, axis=1)[:, :tries]]
        node = np.repeat(np.arange(0, k * width, width), some)
        flat, row = x[low:high].ravel(), np.arange(0, (high - low) * f, f)
        left, mass = np.empty((k, tries, width)), np.empty((k, tries, width))
        for j in range(tries):
            at = node + flat.take(row + np.repeat(np.maximum(drawn[:, j], 0), some))
            left[:, j] = np.bincount(at, w[low:high], k * width).reshape(k, width)
            mass[:, j] = np.bincount(at, wy[low:high], k * width).reshape(k, width)
        np.cumsum(left, axis=2, out=left)
        np.cumsum(mass, axis=2, out=mass)
        whole, total = left[:, 0, -1].copy(), mass[:, 0, -1].copy()
        right, other = whole[:, None, None] - left, total[:, None, None] - mass
        bad = (left < least) | (right < least) | (drawn < 0)[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = mass ** 2 / left + other ** 2 / right
        gain[bad] = -np.inf
        best, nodes = gain.reshape(k, -1).argmax(axis=1), np.arange(k)
        tried, cut = np.divmod(best, width)
        at = nodes, tried, cut
        splits = gain[at] - total ** 2 / whole > 1e-12 * whole
        found.append((drawn[nodes, tried], cut, splits, left[at], mass[at], right[at], other[at]))
    return tuple(np.concatenate(c) for c in zip(*found))


def grown(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, place: np.ndarray, width: int, tries: int, depth: int, least: int, rng):
    """One tree over rows that count ``weight`` times: feature (-1 in a leaf), cut, left child and value of its nodes.

    Nodes lie level by level, siblings side by side. Rows lie by node, so a level reads them in order.
    """
    rows = np.flatnonzero(weight)
    x, w = bins[rows], weight[rows].astype(np.float64)
    wy, whole = w * y[rows], w.sum()
    levels = [(np.full(1, -1, np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.array([wy.sum() / whole if whole else 0.0]))]
    live, size, after = np.zeros(int(whole >= 2 * least and x.shape[1] > 0), np.int64), np.array([len(rows)]), 1
    for level in range(depth):
        if not len(live):
            break
        found, at, splits, wl, sl, wr, sr = _splits(x, w, wy, size, place, width, tries, least, rng)
        feature, cut, left, _ = levels[-1]
        split = live[splits]
        feature[split], cut[split] = found[splits], at[splits]
        left[split] = after + 2 * np.arange(len(split))
        weights = np.stack([wl[splits], wr[splits]], axis=1).ravel()
        value = np.stack([sl[splits], sr[splits]], axis=1).ravel() / weights
        n = len(value)
        levels.append((np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, np.int32), value))
        after += n
        goes_on = (weights >= 2 * least) & (level + 1 < depth)
        # Where each row goes: children side by side, rows in the order they have.
        child = np.zeros(len(size), np.int64)
        child[splits] = 2 * np.arange(len(split))
        right = x.ravel().take(np.arange(0, x.size, x.shape[1]) + np.repeat(np.maximum(found, 0), size)) > np.repeat(at, size)
        ends = np.cumsum(size)
        passed = np.concatenate(([0], np.cumsum(~right)))
        lefts = passed[ends] - passed[ends - size]
        sizes = np.stack([lefts, size - lefts], axis=1)[splits].ravel()
        sizes[~goes_on] = 0
        start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        taken = np.zeros((len(size), 2), bool)
        taken[splits] = goes_on.reshape(-1, 2)
        node = np.repeat(np.arange(len(size)), size)
        kept = np.flatnonzero(taken.ravel().take(2 * node + right))
        node, side = node.take(kept), right.take(kept)
        before = passed.take(kept) - passed[ends - size].take(node)
        place_in = np.where(side, kept - (ends - size).take(node) - before, before)
        order = np.empty(len(kept), np.int64)
        order[start.take(child.take(node) + side) + place_in] = kept
        x, w, wy = x[order], w[order], wy[order]
        live = np.flatnonzero(goes_on)
        size = sizes[live]
    return tuple(np.concatenate(c) for c in zip(*levels))


def _grown_in_task(rows, trees: int, tasks: int, features: int, place, width: int, tries: int, depth: int, least: int, seed: int):
    """The trees of a task; a tree's bootstrap and draws depend on its number and on the order of the blocks only."""
    rows = sorted(rows, key=lambda r: r["block"])
    if not rows:
        return
    task = rows[0]["task"]
    y = np.concatenate([np.frombuffer(r["y"]) for r in rows])
    bins = np.concatenate([np.frombuffer(r["bins"], np.uint8) for r in rows]).reshape(len(y), features)
    del rows
    for tree in range(task, trees, tasks):
        rng = np.random.default_rng([seed, tree])
        feature, cut, left, value = grown(bins, y, rng.poisson(1.0, len(y)).astype(np.uint8), place, width, tries, depth, least, rng)
        yield tree, len(feature), *(bytearray(a.tobytes()) for a in (feature, cut, left, value))


class HistogramForest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """The mean of trees grown by variance, each over a bootstrap of all rows and with a draw of features at every node."""

    def __init__(self, numTrees: int = 20, maxDepth: int = 5, minInstancesPerNode: int = 1, featureSubsetStrategy: str = "onethird",
                 maxBins: int = 32, seed: int | None = None, tasks: int | None = None):
        super().__init__()
        if featureSubsetStrategy not in SUBSETS or not 2 <= maxBins <= 255 or numTrees < 1:
            raise ValueError(f"featureSubsetStrategy {featureSubsetStrategy!r}, maxBins {maxBins!r} or numTrees {numTrees!r}")
        self.trees, self.depth, self.least, self.subset = numTrees, maxDepth, minInstancesPerNode, featureSubsetStrategy
        # Cores that share the trees, all by default.
        self.bins, self.seed, self.tasks = maxBins, seed or 0, tasks

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        size, varied = varied_features(dataset, self.getFeaturesCol(), self.getLabelCol())
        found = [(j, c) for j, c in zip(varied, quantile_cuts(rows, varied, self.bins)) if len(c)]
        used, cuts = [j for j, _ in found], [c for _, c in found]
        place = np.full(len(size["low"]), -1)
        place[used] = np.arange(len(used))
        tasks = min(self.trees, WAVES * (self.tasks or spark.sparkContext.defaultParallelism))
        packed = columns(rows, used, "c").mapInPandas(lambda frames: _packed(frames, cuts, "y"), "bins binary, y binary")
        dealt = packed.withColumn("block", F.monotonically_increasing_id()).withColumn(
            "task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")
        trees = dealt.rdd.mapPartitions(partial(
            _grown_in_task, trees=self.trees, tasks=tasks, features=len(used), place=place, width=max(map(len, cuts), default=0) + 1,
            tries=min(len(place), SUBSETS[self.subset](len(place))), depth=self.depth, least=self.least, seed=self.seed))
        path = scratch_dir(spark, "trees")
        staged(spark.createDataFrame(trees, TREES, verifySchema=False), "trees", path)
        return ForestModel()._set(
            trees=path, used=used, cuts=[float(v) for c in cuts for v in c], cutCounts=[len(c) for c in cuts],
            featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


# -- Scoring -------------------------------------------------------------------------------------

def walked(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of the leaf that each row reaches."""
    flat, row = bins.ravel(), np.arange(0, bins.size, max(1, bins.shape[1]))
    node, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        at = node.take(live)
        tested = feature.take(at)
        go = np.flatnonzero(tested >= 0)
        if not len(go):
            return value.take(node)
        live, at, tested = live.take(go), at.take(go), tested.take(go)
        node[live] = left.take(at) + (flat.take(row.take(live) + tested) > cut.take(at))


def _tile_sums(frames: Iterator[pd.DataFrame], features: int) -> Iterator[pd.DataFrame]:
    """Sums over a chunk of trees, which come first, for the rows of one block after another."""
    trees: list[tuple] = []
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.rows is None:
                trees.append((r.tree, *(np.frombuffer(a, t) for a, t in (
                    (r.feature, np.int16), (r.cut, np.uint8), (r.left, np.int32), (r.value, np.float64)))))
                continue
            ids = np.frombuffer(r.rows, np.int64)
            bins = np.frombuffer(r.bins, np.uint8).reshape(len(ids), features)
            yield pd.DataFrame({"_row": ids, "_sum": sum((walked(bins, *t[1:]) for t in sorted(trees, key=lambda t: t[0])), np.zeros(len(ids)))})


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.stored().write.parquet(f"{path}/trees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str) -> ForestModel:
        return super().load(path)._set(trees=f"{path}/trees")


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """Trees in a stored table, a row each, and the cuts that their bins refer to."""

    trees = Param(Params._dummy(), "trees", "folder of the trees' table", TypeConverters.toString)
    used = Param(Params._dummy(), "used", "features that have cuts", TypeConverters.toListInt)
    cuts = Param(Params._dummy(), "cuts", "upper ends of bins, feature by feature", TypeConverters.toListFloat)
    cutCounts = Param(Params._dummy(), "cutCounts", "cuts of each feature", TypeConverters.toListInt)

    def write(self) -> _ForestWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> _ForestReader:
        return _ForestReader(cls)

    def stored(self) -> DataFrame:
        from pyspark.sql import SparkSession

        return SparkSession.active().read.schema(TREES).parquet(self.getOrDefault(self.trees))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Rows are written once, so that they keep their numbers; tiles of blocks and trees give sums by number."""
        used, name = self.getOrDefault(self.used), self.getPredictionCol()
        counts = self.getOrDefault(self.cutCounts)
        cuts = np.split(np.array(self.getOrDefault(self.cuts), np.float64), np.cumsum(counts)[:-1]) if counts else []
        rows = staged(dataset.withColumn("_row", F.monotonically_increasing_id()), "to-score")
        forest = self.stored()
        whole = forest.agg(F.count("tree").alias("trees"), F.sum(F.col("nodes").cast("long")).alias("nodes")).first()
        chunks = min(whole["trees"], -(-whole["nodes"] * NODE_BYTES // CHUNK_BYTES))
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        parts = max(1, -(-rows.count() // PART_ROWS), -(-cores // chunks))
        blocks = columns(rows.select(vector_to_array(self.getFeaturesCol()).alias("x"), "_row"), used, "c", "_row").mapInPandas(
            lambda frames: _packed(frames, cuts, "_row"), "bins binary, _row binary").select(
            F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.pmod(F.hash("_row"), F.lit(parts)).alias("part"), "bins", F.col("_row").alias("rows"))
        members = forest.select(F.pmod("tree", F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "*")
        tiles = members.unionByName(blocks, allowMissingColumns=True).repartitionById(
            chunks * parts, (F.col("chunk") * parts + F.col("part")).cast("int")).sortWithinPartitions(F.col("rows").isNotNull())
        width = len(used)
        sums = tiles.mapInPandas(lambda frames: _tile_sums(frames, width), "_row long, _sum double")
        means = sums.groupBy("_row").agg((F.sum("_sum") / whole["trees"]).alias(name))
        return rows.join(means, "_row").drop("_row")
