"""Boosted trees over blocks."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.plans import boosting, training


def _rows(spark, n=3000, parts=4):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (n, 4)).astype(float)
    y = 3.0 * (x[:, 0] > 9) + x[:, 1] * x[:, 2] / 50 + rng.normal(0, 0.1, n)
    rows = [(Vectors.dense([*a.tolist(), 7.0]), float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, ["_features", "_label"]).repartition(parts), x, y


def _fitted(rows, **settings):
    return boosting.HistogramBooster(**settings)._set(featuresCol="_features", labelCol="_label", predictionCol="_scaled").fit(rows)


def test_a_tree_splits_where_the_squares_fall_most():
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (3, 900)).astype(np.uint8)
    y = 2.0 * (bins[0] > 4) + bins[1] * bins[2] / 10 + rng.normal(0, 0.1, 900)
    for signs in (False, True):
        response = np.where(y >= 1, 1.0, -1.0) if signs else y

        def total(feature, cut, counted, level):
            return next(boosting._statistics([(bins, y - 1 if signs else y)], feature, cut, counted, level, 8, signs))

        feature, cut, leaf = boosting._grow(total, 3, 10)

        def gain(rows, left):
            sides = [response[rows & left], response[rows & ~left]]
            if min(map(len, sides)) < 10:
                return 0.0
            return sum(s.sum() ** 2 / len(s) for s in sides) - response[rows].sum() ** 2 / rows.sum()

        for level in range(3):
            node = boosting._node(bins, feature, cut, level)
            for k in np.unique(node):
                best = max(gain(node == k, bins[j] <= b) for j in range(3) for b in range(8))
                at = k + (1 << level) - 1
                assert np.isclose(gain(node == k, bins[feature[at]] <= cut[at]), best)
        node = boosting._node(bins, feature, cut, 3)
        assert all(np.isclose(response[node == k].mean(), leaf[k]) for k in np.unique(node))


def test_one_block_and_many_give_the_same_trees(spark, monkeypatch):
    rows, x, y = _rows(spark)
    settings = {"maxIter": 6, "stepSize": 0.5, "maxDepth": 3, "minInstancesPerNode": 5, "lossType": "absolute"}
    one = _fitted(rows, **settings)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 400)
    monkeypatch.setattr(boosting, "PACKED_ROWS", 100)
    monkeypatch.setattr(boosting, "TASK_ROWS", 400)
    monkeypatch.setattr(boosting, "CHECKPOINT_ROUNDS", 2)
    training.ensure_checkpoint_dir(spark)
    many = _fitted(rows, **settings)
    assert one.getOrDefault("feature") == many.getOrDefault("feature") and one.getOrDefault("threshold") == many.getOrDefault("threshold")
    assert np.allclose(one.getOrDefault("leaf"), many.getOrDefault("leaf"))
    scored = one.transform(rows).select(F.avg(F.abs(F.col("_label") - F.col("_scaled")))).first()[0]
    assert scored < 0.5 * np.abs(y - np.median(y)).mean()


def test_squared_loss_fits_what_is_left_and_constants_predict_the_mean(spark):
    rows, _, y = _rows(spark, 500)
    errors = [_fitted(rows, maxIter=k, maxDepth=2).transform(rows).select(F.avg((F.col("_label") - F.col("_scaled")) ** 2)).first()[0] for k in (1, 4, 16)]
    assert errors[0] > errors[1] > errors[2]
    flat = spark.createDataFrame([(Vectors.dense([1.0]), 2.0), (Vectors.dense([1.0]), 4.0)], ["_features", "_label"])
    assert {r["_scaled"] for r in _fitted(flat).transform(flat).collect()} == {3.0}


def test_rounds_over_one_block_need_no_jobs_of_their_own(spark):
    columns = (F.rand(i).alias(c) for i, c in enumerate(C.FEATURES))
    train = spark.range(800).select(*columns).withColumn("target", F.col("lag_1h") * 3 + F.col("lag_24h"))
    spark.sparkContext.setJobGroup("boosted rounds", "boosted rounds")
    try:
        training.train_gbt(train, training.TrainSettings(gbt={"maxIter": 30}))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted rounds")) < 30


def test_fits_share_the_tasks_by_their_rows(spark, monkeypatch):
    seen = {}
    monkeypatch.setitem(training.TRAINERS, "GradientBoosting", lambda rows, settings: seen.setdefault(rows.first()["pollutant"], settings.tasks))
    rows = spark.range(80).select(F.expr("if(id < 60, 'pm25', 'no2')").alias("pollutant"), F.lit(1.0).alias("target"))
    training.train_all(rows, ("GradientBoosting",))
    cores = spark.sparkContext.defaultParallelism
    assert seen == {"pm25": -(-cores * 60 // 80), "no2": -(-cores * 20 // 80)}


def test_a_large_table_is_counted_in_the_tasks_given(spark, monkeypatch):
    rows, _, _ = _rows(spark)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 400)
    monkeypatch.setattr(boosting, "PACKED_ROWS", 100)
    monkeypatch.setattr(boosting, "TASK_ROWS", 400)
    training.ensure_checkpoint_dir(spark)
    parts, total = [], boosting._total
    monkeypatch.setattr(boosting, "_total", lambda rdd: parts.append(rdd.getNumPartitions()) or total(rdd))
    few = _fitted(rows, maxIter=3, maxDepth=2, tasks=2)
    assert set(parts) == {2}
    assert few.getOrDefault("feature") == _fitted(rows, maxIter=3, maxDepth=2).getOrDefault("feature")


def test_joint_bins_of_two_features_give_the_counts_of_each(monkeypatch):
    rng = np.random.default_rng(2)
    bins, rest = rng.integers(0, 9, (3, 500)).astype(np.uint8), rng.normal(size=500)
    seen = []
    for joint in (1 << 12, 1):
        monkeypatch.setattr(boosting, "JOINT_BINS", joint)
        seen.append([next(boosting._statistics([(bins, rest)], np.array([1]), np.array([4]), np.array([True, False]), 1, 9, s)) for s in (False, True)])
    assert all(a.shape == (2, 3, 1, 9) and np.allclose(a, b) for a, b in zip(*seen))


def test_only_features_that_vary_have_their_quantiles_taken(spark, monkeypatch):
    rows, _, _ = _rows(spark)
    seen, cuts = [], boosting.HistogramBooster._cuts
    monkeypatch.setattr(boosting.HistogramBooster, "_cuts", lambda self, rows, features: seen.append(features) or cuts(self, rows, features))
    _fitted(rows, maxIter=2, maxDepth=2)
    assert seen == [[0, 1, 2, 3]]
