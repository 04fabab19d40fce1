"""Boosted regression trees over blocks of binned rows.

Rows are cut into bins once and packed into blocks; a level of a tree is one narrow job that counts bins in every
block and adds the counts up. Only those counts, whose size does not depend on the rows, reach the driver.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a block as packed and as read, the rows of a table whose rounds stay in one task (some 7 MB, as
# a job costs more than counting them), the joint bins up to which two features are counted at once, the partitions whose
# counts the driver adds by itself, the rounds between two checkpoints, and the error of the quantiles that become cuts.
PACKED_ROWS, BLOCK_ROWS, TASK_ROWS = 1 << 14, 1 << 16, 1 << 18
JOINT_BINS = 1 << 12
DIRECT_PARTITIONS = 48
CHECKPOINT_ROUNDS = 50
QUANTILE_ERROR = 0.001
LARGEST = float(np.finfo(np.float64).max)


def _columns(rows: DataFrame, features: list[int]) -> DataFrame:
    """A column ``x<j>`` of each feature, and the label."""
    return rows.select(*(F.col("x")[j].alias(f"x{j}") for j in features), "y")


def columns(rows: DataFrame, features: list[int], prefix: str, other: str = "y") -> DataFrame:
    """Columns of the features by their place among those given, and another one."""
    return rows.select(*(F.col("x")[j].alias(f"{prefix}{i}") for i, j in enumerate(features)), other)


def varied_features(dataset: DataFrame, features: str, label: str):
    """Rows, least and largest features and mean label, and the features with more than one value: others split nothing."""
    low, high = (f(F.col(features)) for f in (Summarizer.min, Summarizer.max))
    size = dataset.agg(F.count(F.lit(1)).alias("n"), low.alias("low"), high.alias("high"), F.avg(F.col(label).cast("double")).alias("mean")).first()
    return size, [j for j in range(len(size["low"])) if size["low"][j] < size["high"][j]]


def quantile_cuts(rows: DataFrame, varied: list[int], bins: int) -> list[np.ndarray]:
    """Upper ends of the bins of each of the features, the last bin's aside."""
    if not varied:
        return []
    shares = [k / bins for k in range(bins)] + [1.0]
    found = _columns(rows, varied).approxQuantile([f"x{j}" for j in varied], shares, QUANTILE_ERROR)
    return [np.unique(q[:-1])[np.unique(q[:-1]) < q[-1]] for q in found]


# -- Blocks --------------------------------------------------------------------------------------

def _packed(frames: Iterator[pd.DataFrame], cuts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Bins of the used features, one feature after the other, next to the labels; value <= cuts[b] has bin <= b."""
    for frame in frames:
        for start in range(0, len(frame), PACKED_ROWS):
            part = frame.iloc[start:start + PACKED_ROWS]
            bins = np.stack([np.searchsorted(c, part.iloc[:, j].to_numpy()).astype(np.uint8) for j, c in enumerate(cuts)])
            yield pd.DataFrame({"bins": [bins.tobytes()], "y": [part["y"].to_numpy(np.float64).tobytes()]})


def _merged(rows, width: int):
    """Packed rows as ``(bins, rest)`` of up to ``BLOCK_ROWS`` rows."""
    held, size = [], 0
    for row in rows:
        rest = np.frombuffer(row["y"])
        held.append((np.frombuffer(row["bins"], np.uint8).reshape(width, -1), rest))
        size += len(rest)
        if size >= BLOCK_ROWS:
            yield np.concatenate([b for b, _ in held], axis=1), np.concatenate([r for _, r in held])
            held, size = [], 0
    if held:
        yield np.concatenate([b for b, _ in held], axis=1), np.concatenate([r for _, r in held])


def _node(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Position of each row among the nodes of a level; nodes lie level by level, children side by side."""
    # Node by node: comparing a feature's column of small numbers is far cheaper than fetching each row's own feature.
    splits = list(zip(feature.tolist(), cut.tolist()))
    node = np.zeros(bins.shape[1], np.min_scalar_type((1 << depth) - 1))
    for level in range(depth):
        right = np.zeros(len(node), bool)
        for k, (f, c) in enumerate(splits[(1 << level) - 1:(2 << level) - 1]):
            if c < 255:
                side = bins[f] > c
                right |= side & (node == k) if level else side
        node <<= 1
        node |= right
    return node


def _advanced(block, tree, depth: int):
    """What is left of the labels after one more tree."""
    (bins, rest), (feature, cut, leaf) = block, tree
    return bins, rest - leaf.take(_node(bins, feature, cut, depth))


def _statistics(blocks, feature, cut, counted, level: int, width: int, signs: bool):
    """Count and sum of the response by feature, pair of siblings and bin, over all blocks of a partition.

    Of each pair only the rows of the node marked in ``counted`` are read; its sibling is what the parent has besides.
    """
    pairs, out = max(1, 1 << level >> 1), 0
    # Two features are counted at once by their joint bins, whose margins are their own.
    joint = width * width if width * width <= JOINT_BINS else width
    for bins, rest in blocks:
        node = _node(bins, feature, cut, level)
        if level:
            rows = np.flatnonzero(counted.take(node))
            node, bins, rest = node.take(rows) >> 1, bins.take(rows, axis=1), rest.take(rows)
        base = node * np.int64(joint)
        if signs:
            base += (rest >= 0) * np.int64(pairs * joint)
        out = out + np.stack([_counts(base + code, None if signs else rest, pairs, joint) for code in _codes(bins, width, joint)], axis=1)
    if isinstance(out, int):
        return
    if joint > width:
        split = out.reshape(*out.shape[:3], width, width)
        # The margins of each pair, one feature after the other; a last one without a partner has been its first.
        out = np.stack([split.sum(axis=4), split.sum(axis=3)], axis=2).reshape(2, -1, pairs, width)[:, :len(bins)]
    yield np.stack([out[0] + out[1], out[1] - out[0]]) if signs else out


def _codes(bins: np.ndarray, width: int, joint: int) -> Iterator[np.ndarray]:
    """Bins of each feature, or joint bins of each two."""
    if joint == width:
        yield from bins
        return
    for j in range(0, len(bins), 2):
        code = bins[j] * np.uint16(width)
        yield code + bins[j + 1] if j + 1 < len(bins) else code


def _counts(at: np.ndarray, weights: np.ndarray | None, pairs: int, joint: int) -> np.ndarray:
    """Count and sum of the weights by place; without weights, the counts of both signs."""
    if weights is None:
        return np.bincount(at, minlength=2 * pairs * joint).reshape(2, pairs, joint)
    return np.stack([np.bincount(at, w, pairs * joint).reshape(pairs, joint) for w in (None, weights)])


def _total(statistics: RDD) -> np.ndarray:
    if statistics.getNumPartitions() <= DIRECT_PARTITIONS:
        return sum(statistics.collect())
    return statistics.treeReduce(operator.add)


# -- Trees ---------------------------------------------------------------------------------------

def _best(statistics: np.ndarray, least: int):
    """Per node: feature, bin, whether it splits, the means of the node and of its sides, whether the left has fewer rows."""
    count, total = statistics.cumsum(axis=-1)
    whole, mass = count[0, :, -1], total[0, :, -1]
    right, other = whole[:, None] - count, mass[:, None] - total
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(whole > 0, mass / whole, 0.0)
        gain = total ** 2 / count + other ** 2 / right - (mass ** 2 / whole)[:, None]
        gain = np.where((count >= least) & (right >= least), gain, -np.inf)
        by_node = gain.transpose(1, 0, 2).reshape(len(whole), -1)
        place = by_node.argmax(axis=1)
        feature, cut = np.divmod(place, count.shape[-1])
        nodes = np.arange(len(whole))
        splits = by_node[nodes, place] > 1e-12 * np.maximum(whole, 1.0)
        left_mean = (total / count)[feature, nodes, cut]
        right_mean = (other / right)[feature, nodes, cut]
    smaller = count[feature, nodes, cut] <= right[feature, nodes, cut]
    return feature, cut, splits, mean, left_mean, right_mean, smaller


def _grow(total, depth: int, least: int):
    """One tree from ``total(feature, cut, counted, level)`` for each level: features and bins of its nodes, and its leaves.

    A node that does not split sends all its rows left.
    """
    feature = np.zeros((1 << depth) - 1, np.int64)
    cut = np.full(len(feature), 255, np.int64)
    leaf = np.zeros(1 << depth)
    alive = np.ones(1, bool)
    statistics, counted = None, np.ones(1, bool)
    for level in range(depth):
        one = np.asarray(total(feature, cut, counted, level), np.float64)
        if level:
            other = np.where(alive[::2, None], statistics - one, 0.0)
            # Without a split all rows of the parent lie in the left node.
            one = np.where(alive[::2, None], one, statistics)
            first = (counted[::2] | ~alive[::2])[:, None]
            one = np.stack([np.where(first, one, other), np.where(first, other, one)], axis=3)
            one = one.reshape(*one.shape[:2], -1, one.shape[-1])
        statistics = one
        found, at, splits, mean, left, right, smaller = _best(statistics, least)
        splits &= alive
        here = slice((1 << level) - 1, (2 << level) - 1)
        feature[here], cut[here] = np.where(splits, found, 0), np.where(splits, at, 255)
        span = 1 << (depth - level)
        leaf[::span] = np.where(splits, 0.0, mean)
        if level == depth - 1:
            leaf[::2], leaf[1::2] = np.where(splits, left, mean), np.where(splits, right, 0.0)
        alive = np.repeat(splits, 2)
        counted = np.stack([smaller, ~smaller], axis=1).ravel() & alive
        if not alive.any():
            break
    return feature, cut, leaf


def _rounds_in_task(rows, features: int, rounds: int, step: float, depth: int, least: int, width: int, absolute: bool):
    """All trees of a table of few blocks, which never leave their task."""
    blocks, trees = list(_merged(rows, features)), []
    for k in range(rounds):
        def total(feature, cut, counted, level):
            return next(_statistics(blocks, feature, cut, counted, level, width, absolute and k > 0))

        feature, cut, leaf = _grow(total, depth, least)
        trees.append((feature, cut, leaf * (step if k else 1.0)))
        blocks = [_advanced(block, trees[-1], depth) for block in blocks]
    yield trees


class HistogramBooster(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Gradient boosting for absolute or squared loss; the first tree fits the labels, the others add ``stepSize`` of theirs."""

    def __init__(self, maxIter: int = 20, stepSize: float = 0.1, maxDepth: int = 5, minInstancesPerNode: int = 1,
                 lossType: str = "squared", maxBins: int = 32, seed: int | None = None, tasks: int | None = None):
        super().__init__()
        if lossType not in ("absolute", "squared") or not 2 <= maxBins <= 255:
            raise ValueError(f"lossType {lossType!r} or maxBins {maxBins!r}")
        self.rounds, self.step, self.depth, self.least = maxIter, stepSize, maxDepth, minInstancesPerNode
        # Nothing is drawn: the same rows give the same trees, whatever the seed.
        self.absolute, self.bins, self.seed = lossType == "absolute", maxBins, seed
        # Tasks that count a large table's rows, one for each core by default.
        self.tasks = tasks

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def setPredictionCol(self, value: str):
        return self._set(predictionCol=value)

    def _cuts(self, rows: DataFrame, varied: list[int]) -> list[np.ndarray]:
        return quantile_cuts(rows, varied, self.bins)

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        rows = dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        # A feature with one value splits nothing, and its quantiles need no pass.
        size, varied = varied_features(dataset, self.getFeaturesCol(), self.getLabelCol())
        found = [(j, c) for j, c in zip(varied, self._cuts(rows, varied)) if len(c)]
        used, cuts = [j for j, _ in found], [c for _, c in found]
        if not used:
            return self._model([], [], [size["mean"]], 0)
        width = max(map(len, cuts)) + 1
        sc = dataset.sparkSession.sparkContext
        parts = min(self.tasks or sc.defaultParallelism, -(-size["n"] // BLOCK_ROWS)) if size["n"] > TASK_ROWS else 1
        packed = _columns(rows, used).mapInPandas(lambda frames: _packed(frames, cuts), "bins binary, y binary").repartition(parts)
        if size["n"] <= TASK_ROWS:
            trees = packed.rdd.mapPartitions(partial(
                _rounds_in_task, features=len(used), rounds=self.rounds, step=self.step, depth=self.depth, least=self.least,
                width=width, absolute=self.absolute)).first()
        else:
            trees = self._rounds(packed.rdd.mapPartitions(partial(_merged, width=len(used))), width)
        ends = np.full((len(used), 256), LARGEST)
        for row, c in zip(ends, cuts):
            row[:len(c)] = c
        return self._model(
            [used[f] for feature, _, _ in trees for f in feature],
            [float(v) for feature, cut, _ in trees for v in ends[feature, cut]],
            [float(v) for _, _, leaf in trees for v in leaf], self.depth)

    def _rounds(self, state: RDD, width: int) -> list[tuple]:
        """All trees, by a job for each level; what is left of the labels stays with the blocks from round to round."""
        trees, before = [], None
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        for k in range(self.rounds):
            def total(feature, cut, counted, level):
                return _total(state.mapPartitions(partial(
                    _statistics, feature=feature, cut=cut, counted=counted, level=level, width=width, signs=self.absolute and k > 0)))

            feature, cut, leaf = _grow(total, self.depth, self.least)
            trees.append((feature, cut, leaf * (self.step if k else 1.0)))
            if before is not None:
                before.unpersist()
            before, state = state, state.map(partial(_advanced, tree=trees[-1], depth=self.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if (k + 1) % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
        before.unpersist()
        return trees

    def _model(self, feature: list, threshold: list, leaf: list, depth: int) -> BoostedTrees:
        model = BoostedTrees()._set(feature=feature, threshold=threshold, leaf=leaf, depth=depth)
        return model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


def _sums(values: np.ndarray, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, depth: int) -> np.ndarray:
    """Sum of the leaves that each row of ``values`` reaches."""
    out, flat = np.zeros(len(values)), values.ravel()
    start = np.arange(len(values)) * values.shape[1]
    for f, t, v in zip(feature, threshold, leaf):
        node = np.zeros(len(values), np.int64)
        for level in range(depth):
            at = node + ((1 << level) - 1)
            node = 2 * node + (flat.take(start + f[at]) > t[at])
        out += v[node]
    return out


class BoostedTrees(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Complete trees of one depth: a feature and a threshold for each inner node, then the leaves."""

    feature = Param(Params._dummy(), "feature", "feature of each inner node, tree by tree", TypeConverters.toListInt)
    threshold = Param(Params._dummy(), "threshold", "rows above it go right", TypeConverters.toListFloat)
    leaf = Param(Params._dummy(), "leaf", "what a leaf adds, tree by tree", TypeConverters.toListFloat)
    depth = Param(Params._dummy(), "depth", "levels of inner nodes", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        depth = self.getOrDefault(self.depth)
        leaf = np.array(self.getOrDefault(self.leaf)).reshape(-1, 1 << depth)
        feature = np.array(self.getOrDefault(self.feature), np.int64).reshape(len(leaf), -1)
        threshold = np.array(self.getOrDefault(self.threshold), np.float64).reshape(len(leaf), -1)

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="float64")
            return pd.Series(_sums(np.stack(rows.to_numpy()), feature, threshold, leaf, depth))

        return dataset.withColumn(self.getPredictionCol(), score(vector_to_array(self.getFeaturesCol())))
