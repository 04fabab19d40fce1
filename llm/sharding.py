"""Uniform shuffle into shards of exact size by a communication matrix of hypergeometric draws.

How many rows of each partition go to each shard is drawn first, so that every assignment of rows to shards
of the exact sizes is equally likely. Each partition permutes its rows and deals them by its row of the
matrix, rows are exchanged once, and each block of a shard is permuted again. Shards are cut into blocks of
exact sizes, which are the columns of the matrix; so places in the shard are known without another pass and
no task ever holds a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
_SMALL = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn without replacement; totals beyond the library's limit by inversion."""
    if good + bad < _SMALL:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    sigma = math.sqrt(mean * (bad / (good + bad)) * ((good + bad - n) / (good + bad - 1)))
    # Beyond twelve deviations and a bit lies less than a double can tell.
    x = np.arange(max(low, int(mean - 12 * sigma - 40)), min(high, int(mean + 12 * sigma + 40)) + 1, dtype=np.float64)
    step = np.log((good - x[:-1]) * (n - x[:-1])) - np.log((x[:-1] + 1) * (bad - n + x[:-1] + 1))
    weight = np.append(0.0, np.cumsum(step))
    share = np.cumsum(np.exp(weight - weight.max()))
    return int(x[np.searchsorted(share, rng.random() * share[-1], "right")])


def drawn(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How n rows drawn without replacement spread over columns with this room."""
    total = int(room.sum())
    if total < _SMALL:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    out = np.zeros(len(room), np.int64)
    for k, one in enumerate(room.tolist()):
        out[k] = hypergeometric(rng, one, total - one, n)
        total, n = total - one, n - int(out[k])
    return out


def matrix_row(partition: int, ends: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """One partition's row of the matrix, from the partitions' cumulated counts and the columns' sizes.

    The range of partitions is halved until one is left, and the columns' room is split between the halves
    by draws seeded by the range. Every task draws the same splits, so rows agree without being exchanged.
    """
    low, high = 0, len(ends) - 1
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(np.random.default_rng([seed, 0, low, high]), room, int(ends[middle] - ends[low]))
        if partition < middle:
            room, high = left, middle
        else:
            room, low = room - left, middle
    return room


def block_sizes(rows: int, shards: int, least: int) -> tuple[np.ndarray, int]:
    """Sizes of all blocks, shard by shard, and blocks to a shard. Shards and blocks differ by one row at most."""
    block = max(least, math.isqrt(rows))
    each = max(1, -(-rows // (shards * block)))
    shard = rows // shards + (np.arange(shards) < rows % shards)
    return (shard[:, None] // each + (np.arange(each) < shard[:, None] % each)).ravel().astype(np.int64), each


def shuffle_to_shards(df: DataFrame, shards: int = SHARDS, seed: int = 17, shard_col: str = "shard",
                      slot_col: str = "slot", least_block: int = 2048) -> DataFrame:
    """All rows of ``df`` with a shard and a slot, gapless from 0 in each shard; counts are at most one apart.

    Every placement of the rows is equally likely, whatever they hold: nulls, ties and repeated rows are rows
    like any other. Columns of the new names are replaced. An empty table gives no rows. The input is read
    twice and must give the same partitions each time, as table scans do; stage anything else first. The
    driver sees a count for each partition, tasks the counts and the block sizes.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    inner = df.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(kept)])
    counts = {r["p"]: r["count"] for r in inner.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    per = np.array([counts.get(p, 0) for p in range(max(counts, default=-1) + 1)], np.int64)
    ends = np.append(0, np.cumsum(per))
    sizes, each = block_sizes(int(ends[-1]), shards, least_block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        n = int(per[p]) if p < len(per) else 0
        rng = np.random.default_rng([seed, 1, p])
        to = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(p, ends, sizes, seed))) if n else np.empty(0, np.int32)
        at = 0
        for batch in batches:
            rows = batch.num_rows
            if at + rows > n:
                raise RuntimeError("the input's partitions changed between two reads")
            yield pa.record_batch([*batch.columns, pa.array(to[at:at + rows]), pa.array(rng.integers(0, 2**63, rows)),
                                   pa.array((p << 33) + np.arange(at, at + rows))],
                                  names=[*batch.schema.names, "_block", "_key", "_row"])
            at += rows
        if at != n:
            raise RuntimeError("the input's partitions changed between two reads")

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema), "_block int, _key long, _row long"])
    again = F.row_number().over(Window.partitionBy("_block").orderBy("_key", "_row"))
    shard, j = F.floor(F.col("_block") / each).cast("int"), (F.col("_block") % each).cast("long")
    size = F.lit(int(ends[-1]) // shards).cast("long") + (shard < int(ends[-1]) % shards).cast("long")
    start = j * F.floor(size / each) + F.least(j, size % each)
    return inner.mapInArrow(deal, schema).withColumn("_place", again).select(
        *[F.col(f"_{k}").alias(c) for k, c in enumerate(kept)], shard.alias(shard_col),
        (start + F.col("_place") - 1).cast("long").alias(slot_col))
