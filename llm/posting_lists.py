"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted by balanced clustering on a bounded sample; their number follows the number of vectors
up to a limit. Each vector goes to the lists of its nearest centroids, several if it lies near a boundary.
Tasks find centroids with a neighbour graph in memory. A query visits the lists whose centroids are at most
a ratio farther than its nearest one; the ratio is fitted to the recall of searches within the sample. Lists are cut into chunks, so a crowded list is several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import hashed_sample, stage
from llm.vectors import matrix, one_length, unit, valid

#: Vectors the centroids are fitted on, whatever the input's size.
SAMPLE = 16_384
LIST = 256
CENTROIDS = 4096
REPLICAS = 4
BOUNDARY = 1.12
#: Share of true neighbours, within the sample, that the fitted ratio finds; at least WIDTH centroids are looked at.
RECALL = 0.97
HELD = 512
WIDTH = 64
DEGREE = 24
CHUNK = 4096
NEAREST = 5
#: Cosines with centroids held at once where a query looks at all, and rows of a batch that goes back to Spark.
CELLS = 1 << 20
PIECE = 4096


@dataclass(frozen=True)
class Index:
    """Centroids of unit length, for each the ids of its neighbours in the graph, and the pruning ratio fitted to them."""

    centroids: np.ndarray
    graph: np.ndarray
    ratio: float = 1.0


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Clustering on the sphere in which a crowded cluster's pull weakens round by round."""
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    penalty = np.zeros(len(centre))
    for _ in range(rounds):
        near = np.concatenate([(x[i:i + 4096] @ centre.T - penalty).argmax(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=len(centre))
        penalty = np.maximum(0, penalty + 0.02 * (size * len(centre) / len(x) - 1))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1))
        full = norm > 1e-12
        centre[full] = total[full] / norm[full, None]
    return centre


def neighbour_graph(centre: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Near neighbours and a ring through all, so that every centroid can be reached."""
    n = len(centre)
    out = np.empty((n, min(degree, n - 1) + 2), np.int32)
    for i in range(0, n, 1024):
        near = centre[i:i + 1024] @ centre.T
        near[np.arange(len(near)), np.arange(i, i + len(near))] = -2
        out[i:i + 1024, 2:] = np.argsort(-near, axis=1, kind="stable")[:, :out.shape[1] - 2]
    own = np.arange(n)
    # A neighbour that is listed already gives way to the centroid itself, which a search has always seen.
    for k, ring in enumerate(((own + 1) % n, (own - 1) % n)):
        out[:, k] = np.where((out[:, 2:] == ring[:, None]).any(1) | (k == 1) & (out[:, 0] == ring), own, ring)
    return out


def search_graph(index: Index, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids found for each row, best first, and their cosines; missing ones are -1.

    Best-first search of all rows in step: each round every row opens its best candidate not opened yet,
    until all of the best ``width`` have been.
    """
    n, k = len(x), len(index.centroids)
    width = min(width, k)
    seen = np.zeros((n, k), bool)
    start = np.linspace(0, k - 1, num=min(k, 8), dtype=np.int64)
    ids = np.full((n, width + index.graph.shape[1] + len(start)), -1)
    cos = np.full(ids.shape, -np.inf)
    opened = np.zeros(ids.shape, bool)
    ids[:, :len(start)], cos[:, :len(start)] = start, x @ index.centroids[start].T
    seen[:, start] = True
    live = np.arange(n)
    while len(live):
        order = np.argsort(-cos[live], axis=1, kind="stable")
        for a in (ids, cos, opened):
            a[live] = np.take_along_axis(a[live], order, 1)
        ids[live, width:], cos[live, width:], opened[live, width:] = -1, -np.inf, False
        todo = (ids[live, :width] >= 0) & ~opened[live, :width]
        live = live[todo.any(1)]
        if not len(live):
            break
        best = ((ids[live, :width] >= 0) & ~opened[live, :width]).argmax(1)
        opened[live, best] = True
        more = index.graph[ids[live, best]].astype(np.int64)
        fresh = ~seen[live[:, None], more]
        seen[live[:, None], more] = True
        value = np.einsum("nd,nkd->nk", x[live], index.centroids[more])
        ids[live, width:width + more.shape[1]] = np.where(fresh, more, -1)
        cos[live, width:width + more.shape[1]] = np.where(fresh, value, -np.inf)
    return ids[:, :width], cos[:, :width]


def _distance(cos):
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


def replicas(index: Index, x: np.ndarray) -> list[np.ndarray]:
    """Lists of each row: centroids within the boundary ratio, skipping one that a chosen one lies nearer to."""
    ids, cos = search_graph(index, x, 4 * REPLICAS)
    far = _distance(cos)
    out = []
    for row, d in zip(ids, far, strict=True):
        chosen: list[int] = []
        for c, dist in zip(row.tolist(), d.tolist(), strict=True):
            if c < 0 or dist > BOUNDARY * d[0] + 1e-12 or len(chosen) == REPLICAS:
                break
            if all(_distance(index.centroids[c] @ index.centroids[o]) > dist for o in chosen):
                chosen.append(c)
        out.append(np.array(chosen, np.int32))
    return out


def fitted_ratio(index: Index, x: np.ndarray, k: int = NEAREST, recall: float = RECALL, held: int = HELD) -> float:
    """The ratio at which searches for ``held`` rows of the sample find ``recall`` of their true neighbours in it.

    A neighbour is found by the nearest of its lists. Neighbours in the whole table are nearer than those in
    the sample, so the share found there is rather larger.
    """
    if len(x) < 2:
        return 1.0
    q = x[:held]
    cos = q @ x.T
    cos[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-cos, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
    far = _distance(q @ index.centroids.T)
    lists = dict(zip((at := np.unique(near)).tolist(), replicas(index, x[at]), strict=True))
    least = np.maximum(far.min(1), 1e-9)
    needed = [far[i, lists[j]].min() / least[i] for i, row in enumerate(near.tolist()) for j in row]
    return float(max(1.0, np.quantile(needed, recall)))


def fit(rows: DataFrame, total: int, per_list: int = LIST, sample: int = SAMPLE) -> Index:
    """Centroids from the ``sample`` vectors whose ids hash lowest; about one for ``per_list`` vectors."""
    taken = hashed_sample(rows, "id", sample, total).select("vector").toArrow()
    x = unit(matrix(taken.column(0).combine_chunks()))
    centre = balanced_centroids(x, int(min(max(1, -(-total // per_list)), CENTROIDS, len(x))))
    index = Index(centre, neighbour_graph(centre))
    return replace(index, ratio=fitted_ratio(index, x))


def ranked(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All centroids of each row, best first, and their cosines."""
    cos = x @ index.centroids.T
    ids = np.argsort(-cos, axis=1, kind="stable")
    return ids, np.take_along_axis(cos, ids, 1)


def visited(index: Index, x: np.ndarray, ratio: float, sizes: np.ndarray, need: int) -> list[np.ndarray]:
    """Lists of each query: those within the ratio, and on to the next ones until they hold enough entries.

    The graph is searched for ``WIDTH`` centroids; only queries that want the last of these look at all, a few queries
    at a time: a wider search of the graph would sort its candidates at every step.
    """
    out: list[np.ndarray] = [None] * len(x)

    def take(rows: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> np.ndarray:
        far = _distance(cos)
        held = np.cumsum(np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0), axis=1)
        before = np.concatenate((np.zeros((len(ids), 1), held.dtype), held[:, :-1]), axis=1)
        keep = (ids >= 0) & ((far <= ratio * far[:, :1] + 1e-12) | (before < need))
        done = ~keep[:, -1] | (ids.shape[1] >= len(index.centroids))
        for row in np.flatnonzero(done).tolist():
            out[rows[row]] = ids[row][keep[row]].astype(np.int32)
        return rows[~done]

    todo = take(np.arange(len(x)), *search_graph(index, x, WIDTH))
    step = max(1, CELLS // len(index.centroids))
    for first in range(0, len(todo), step):
        rows = todo[first:first + step]
        take(rows, *ranked(index, x[rows]))
    return out


def _pieces(part: pa.RecordBatch, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each list of each row, ``PIECE`` at a time: a query may visit thousands of lists."""
    row, lists = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found).astype(np.int32)
    for first in range(0, len(row), PIECE):
        at = pa.array(row[first:first + PIECE])
        yield pa.record_batch([pa.array(lists[first:first + PIECE]), *(c.take(at) for c in part.columns)], names=["list", *part.schema.names])


def _lists(shared, sizes=None, need=0, ratio=None):
    """(list, id, vector) rows: of the index, or of queries if the lists' sizes are given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                x = unit(matrix(part.column(1)))
                found = replicas(index, x) if sizes is None else visited(index, x, ratio or index.ratio, sizes, need)
                yield from _pieces(part, found)

    return run


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each summed in the same order wherever the rows stand."""
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def _best(nearest):
    """For one tile after another, the nearest vectors of each query: (query, id, score)."""
    def tile(table: pa.Table) -> pa.RecordBatch:
        is_query = table.column("is_query").to_numpy()
        ids, x = table.column("id").to_numpy(), matrix(table.column("vector").combine_chunks())
        least = table.column("ids").combine_chunks()
        q, v = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        one, two = unit(x[q]), unit(x[v])
        out_q, out_v, out_s = [], [], []
        for k in range(0, len(q), 256):
            rough = one[k:k + 256] @ two.T
            # One more than asked for, as the query may find itself; ties and rounding stay in.
            keep = min(nearest + 1, len(v))
            edge = np.partition(rough, len(v) - keep, axis=1)[:, len(v) - keep]
            i, j = np.nonzero(rough >= edge[:, None] - 1e-12)
            out_q.append(q[k + i])
            out_v.append(v[j])
            out_s.append(cosines(x[q[k + i]], x[v[j]]))
        a, b, s = np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)
        # A vector stands for all rows equal to it; their least ids, one more than asked for, come with it.
        offsets, flat = least.offsets.to_numpy(), least.values.to_numpy(zero_copy_only=False)
        sizes = offsets[b + 1] - offsets[b]
        each = np.repeat(np.arange(len(b)), sizes)
        other = flat[np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in b.tolist()])] if len(b) else flat[:0]
        query, score = ids[a][each], s[each]
        fine = query != other
        query, other, score = query[fine], other[fine], score[fine]
        order = np.lexsort((other, -score, query))
        query, other, score = query[order], other[order], score[order]
        first = np.searchsorted(query, query)
        top = np.arange(len(query)) - first < nearest
        return pa.record_batch([query[top], other[top], score[top]], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def ready():
            table = pa.Table.from_batches(held)
            sides = table.column("is_query").to_numpy()
            return tile(table) if sides.any() and not sides.all() else None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("list", "chunk", "part")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                this = tuple(int(k[start]) for k in keys)
                if held and this != now:
                    if (out := ready()) is not None:
                        yield out
                    held = []
                now = this
                held.append(batch.slice(start, end - start))
        if held and (out := ready()) is not None:
            yield out

    return run


def _few(least):
    """Equal vectors of a batch in one row with their least ids: what can be combined before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            order = np.lexsort((ids, np.unique(x, axis=0, return_inverse=True)[1].ravel()))
            same = np.append(False, (x[order][1:] == x[order][:-1]).all(1))
            group = np.cumsum(~same) - 1
            place = np.arange(len(order)) - np.searchsorted(group, group)
            keep = order[place < least]
            keep_group = group[place < least]
            first = order[~same]
            ends = np.searchsorted(keep_group, np.arange(group[-1] + 2))
            yield pa.record_batch([
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[keep])), batch.column(1).take(pa.array(first))],
                names=["ids", "vector"])

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = NEAREST, ratio: float | None = None, per_list: int = LIST,
            chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows of ``df`` for each row of ``queries`` but itself.

    The score is the cosine of the original vectors in double precision; ties go to the smaller id. Rows
    without an id and vectors that are null, zero or hold null or non-finite components take no part. Every
    other row is indexed, equal vectors in one entry with the k + 1 least ids, beyond which no row can be among
    k nearest. ``ratio`` is fitted unless given. Repeated queries count once. Without queries or vectors there are no rows.
    """
    spark = df.sparkSession

    def plain(frame):
        rows = frame.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        return rows.where(F.col("id").isNotNull() & valid("vector"))

    # Queries are few rows and much work: they are not merged into few tasks.
    asked = plain(queries).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").dropDuplicates(["id"])
    rows = plain(df)
    if one_length(rows) is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = spark.sparkContext.broadcast(fit(rows, rows.count(), per_list))  # CENTROIDS rows at most
    entries = rows.select("id", "vector").mapInArrow(_few(k + 1), "ids array<long>, vector array<double>").groupBy("vector").agg(
        F.flatten(F.collect_list("ids")).alias("ids"))
    entries = entries.select("vector", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids")).withColumn("id", F.col("ids")[0])
    lists = stage(entries.select("id", "vector", "ids").mapInArrow(_lists(index), "list int, id long, vector array<double>, ids array<long>"), "lists")
    held = np.zeros(len(index.value.centroids), np.int64)
    for row in lists.groupBy("list").count().collect():  # CENTROIDS rows at most
        held[row["list"]] = row["count"]
    # An entry may be in REPLICAS lists, so these hold k entries besides the query's own.
    wanted = stage(asked.mapInArrow(_lists(index, held, REPLICAS * (k + 1), ratio), "list int, id long, vector array<double>"), "queries")

    # Tiles of list chunk and query part, from the sizes of lists: a row each for at most CENTROIDS lists.
    sizes = lists.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_c")).join(
        wanted.groupBy("list").agg(F.ceil(F.count("*") / chunk).cast("int").alias("_p")), "list")
    member = lists.join(F.broadcast(sizes), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("_c")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).select("list", "chunk", "part", F.lit(False).alias("is_query"), "id", "vector", "ids")
    query = wanted.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_p")).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).select(
        "list", "chunk", "part", F.lit(True).alias("is_query"), "id", "vector", F.array().cast("array<long>").alias("ids"))
    tiles = member.union(query).repartition("list", "chunk", "part").sortWithinPartitions("list", "chunk", "part", "id")
    best = tiles.mapInArrow(_best(k), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
