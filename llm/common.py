"""Scratch tables in the cluster's shared folder, and connected components on them."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def small_batches(spark: SparkSession) -> None:
    """Rows of long texts reach Python 2000 at a time, which bounds what a worker and its JVM hold for a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder below the warehouse takes its place; both are shared by all
    executors, so staged data outlives any of them.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and its rows no longer vary."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """The n rows whose keys hash lowest. Of a large table only about 2 n rows reach the task that orders them."""
    if total > 4 * n:
        df = df.where(F.shiftrightunsigned(F.xxhash64(key), 32) < int(2 * n / total * 2**32))
    return df.orderBy(F.shiftrightunsigned(F.xxhash64(key), 32), key).limit(n)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges a-b; no edge for the smallest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_HELD = 500_000


def _contract(batches):
    """Replace edges by star edges, at most ``_HELD`` new edges at a time; components stay the same."""
    def stars(held):
        table = pa.Table.from_batches(held)
        u, v = forest(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.record_batch([u, v], schema=_EDGES)

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows > _HELD:
            yield stars(held)
            held, rows = [], 0
    if held:
        yield stars(held)


def _to_least(df: DataFrame, keep_larger: bool) -> DataFrame:
    """Each u's neighbours v, linked to the least of them (and of u itself)."""
    least = df.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = df.join(least, "u")
    if keep_larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.where("u != m").select("u", F.col("m").alias("v")))


def components(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) for each node of the links in the first two columns: the least node of its component.

    Links are contracted to stars inside each partition; then large-star and small-star rounds alternate
    until nothing changes. Each round is two aggregations with joins on the same key; no node's links are
    ever gathered in one row. Rounds are staged, so a lost executor costs one round at most.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in edges.columns[:2])
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v")
    links = links.repartition(F.col("v")).mapInArrow(_contract, "u long, v long")
    links = stage(links.distinct(), label)

    def mark(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(links)
    while last[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True).distinct()
        new = stage(_to_least(large, False).distinct(), label)
        now = mark(new)
        drop_staged(links)
        links = new
        if now == last:
            break
        last = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", "v").distinct())
