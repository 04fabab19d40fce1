"""Forests whose trees grow in tasks and stay in files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hourgrid.plans import forest, training
from tests.test_boosting import _rows


def _fitted(rows, **settings):
    return forest.HistogramForest(**settings)._set(featuresCol="_features", labelCol="_label", predictionCol="_scaled").fit(rows)


def _leaves(bins, tree):
    feature, cut, left, _ = tree
    node = np.zeros(len(bins), int)
    while (inner := np.flatnonzero(feature[node] >= 0)).size:
        at = node[inner]
        node[inner] = left[at] + (bins[inner, feature[at]] > cut[at])
    return node


def test_a_tree_splits_where_the_squares_fall_most_and_its_leaves_are_means(monkeypatch):
    monkeypatch.setattr(forest, "CELLS", 100)  # a few nodes at once
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (900, 3)).astype(np.uint8)
    y = 2.0 * (bins[:, 0] > 4) + bins[:, 1] * bins[:, 2] / 10 + rng.normal(0, 0.1, 900)
    weight = rng.poisson(1.0, 900).astype(np.uint8)
    tree = forest.grown(bins, y, weight, np.array([0, -1, 1, 2]), 8, 4, 30, 10, np.random.default_rng(2))
    feature, cut, left, value = tree
    rows = {0: np.arange(900)}

    def gain(at, right):
        counts = [weight[at][side].sum() for side in (right, ~right)]
        if min(counts) < 10:
            return 0.0
        sums = [(weight[at] * y[at])[side].sum() for side in (right, ~right)]
        return sums[0] ** 2 / counts[0] + sums[1] ** 2 / counts[1] - sum(sums) ** 2 / sum(counts)

    for k in range(len(feature)):
        at = rows[k]
        best = max(gain(at, bins[at, j] > b) for j in range(3) for b in range(8))
        if feature[k] < 0:
            assert best < 1e-9 and np.isclose(np.average(y[at], weights=weight[at]), value[k])
            continue
        right = bins[at, feature[k]] > cut[k]
        assert np.isclose(gain(at, right), best)
        rows[left[k]], rows[left[k] + 1] = at[~right], at[right]
    assert len(rows) == len(feature) > 50 and (feature < 0).sum() == (feature >= 0).sum() + 1
    assert np.array_equal(forest.walked(bins, *tree), value[_leaves(bins, tree)])


def test_depth_bounds_a_tree_and_a_draw_without_a_split_ends_it():
    rng = np.random.default_rng(0)
    bins, weight = rng.integers(0, 30, (500, 2)).astype(np.uint8), np.ones(500, np.uint8)
    y = bins[:, 0] + bins[:, 1] / 7.0
    assert len(forest.grown(bins, y, weight, np.arange(2), 30, 2, 3, 1, rng)[0]) == 15
    assert forest.grown(bins, y, weight, np.full(4, -1), 30, 2, 3, 1, rng)[3].tolist() == [pytest.approx(y.mean())]
    assert len(forest.grown(bins[:, :0], y, weight, np.full(4, -1), 1, 2, 3, 1, rng)[0]) == 1
    assert len(forest.grown(bins, y, weight, np.arange(2), 30, 2, 3, 300, rng)[0]) == 1


def test_no_tree_reaches_the_driver_and_a_forest_is_the_mean_of_its_trees(spark, tmp_path, monkeypatch):
    rows, x, y = _rows(spark)
    settings = {"numTrees": 9, "maxDepth": 30, "minInstancesPerNode": 10, "featureSubsetStrategy": "sqrt", "seed": 3}
    model = _fitted(rows, **settings)
    assert not any(isinstance(v, list) and len(v) > 200 for v in model.extractParamMap().values())
    trees = model.stored().collect()
    assert sorted(t.tree for t in trees) == list(range(9)) and all(t.nodes > 50 for t in trees)
    cuts = np.split(np.array(model.getOrDefault("cuts")), np.cumsum(model.getOrDefault("cutCounts"))[:-1])
    found = sorted((tuple(r["_features"]), r["_scaled"]) for r in model.transform(rows).collect())
    bins = np.stack([np.searchsorted(c, np.array([f[j] for f, _ in found])) for j, c in zip(model.getOrDefault("used"), cuts)], axis=1).astype(np.uint8)
    each = [forest.walked(bins, *(np.frombuffer(t[c], k) for c, k in (("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("value", np.float64)))) for t in trees]
    assert len(found) == 3000 and np.allclose(np.mean(each, axis=0), [v for _, v in found])
    # Tiles of a few trees and blocks say the same, and so does a model stored and loaded.
    model.write().save(str(tmp_path / "forest"))
    monkeypatch.setattr(forest, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(forest, "PART_ROWS", 700)
    monkeypatch.setattr(forest, "PACKED_ROWS", 128)
    again = forest.ForestModel.load(str(tmp_path / "forest"))
    assert again.getOrDefault("trees") == str(tmp_path / "forest") + "/trees"
    assert np.allclose(sorted(r["_scaled"] for r in again.transform(rows).collect()), sorted(v for _, v in found))
    error = np.mean([(r["_scaled"] - r["_label"]) ** 2 for r in again.transform(rows).collect()])
    assert error < 0.2 * y.var()


def test_a_forest_does_not_depend_on_its_tasks_and_constants_give_the_mean(spark):
    rows, _, _ = _rows(spark, 600)
    rows = rows.localCheckpoint()
    one, many = (sorted(map(tuple, _fitted(rows, numTrees=7, maxDepth=8, tasks=k).stored().collect())) for k in (1, 3))
    assert one == many
    flat = spark.createDataFrame([(Vectors.dense([1.0]), 2.0)] * 4, ["_features", "_label"])
    assert {r["_scaled"] for r in _fitted(flat, numTrees=3).transform(flat).collect()} == {2.0}


def test_training_grows_the_whole_forest_without_the_driver(spark):
    train = spark.range(400).select(*(F.rand(i).alias(c) for i, c in enumerate(training.C.FEATURES)), (F.rand(50) * 3).alias("target"))
    model = training.train_forest(train, training.TrainSettings(forest={"maxDepth": 3}))
    stages = [s for s in model.stages if isinstance(s, forest.ForestModel)]
    assert len(stages) == 1 and stages[0].stored().count() == training.RF_PARAMS["numTrees"] == 200
    assert training.RF_PARAMS["minInstancesPerNode"] == 10 and training.RF_DEPTH == 30


def test_a_forest_takes_a_few_jobs_whatever_its_depth(spark):
    train = spark.range(3000).select(*(F.rand(i).alias(c) for i, c in enumerate(training.C.FEATURES)), (F.rand(50) * 3).alias("target"))
    spark.sparkContext.setJobGroup("whole forest", "whole forest")
    try:
        model = training.train_forest(train)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole forest")) < 20
    assert next(s for s in model.stages if isinstance(s, forest.ForestModel)).stored().agg(F.avg("nodes")).first()[0] > 100
