"""Exact metric range join of embeddings with pivots.

Vectors go to the cell of their nearest pivot. On the unit sphere a cosine of at least 0.95 is a distance of
at most ``sqrt(2 - 2 * 0.95)``. If x of cell i has a partner in cell j within that radius r, the triangle
inequality gives d(x, p_j) <= d(x, p_i) + 2 r, and d(x, p_j) <= R_j + r with R_j the cell's own radius; x is
copied to just those cells, and of two cells one compares the pair. Cells join independently, members and
copies cut into blocks by their own counts, so neither a crowded cell nor one that most vectors are copied to,
nor a third of all vectors in one spot, makes a large task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, forest, hashed_sample, stage
from llm.vectors import classes, matrix, one_length, unit

COSINE = 0.95
PIVOTS = 12
BLOCK = 4096
#: Vectors that pivots are picked from: the bound of what the fit reads.
SAMPLE = 1024
_SLACK = 1e-9


def pick_pivots(x: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, each farthest from those before."""
    chosen = [0]
    far = 2 - 2 * (x @ x[0])
    while len(chosen) < min(k, len(x)):
        nxt = int(far.argmax())
        if far[nxt] < 1e-12:
            break
        chosen.append(nxt)
        far = np.minimum(far, 2 - 2 * (x @ x[nxt]))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def _homes(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(unit(matrix(batch.column(0))), pivots)
                yield pa.record_batch([d.argmin(1).astype(np.int32), d.min(1)], names=["cell", "d"])

    return run


def compares(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether cell i, not j, compares vectors of the two cells; even and odd sums share the work out."""
    return (i < j) == ((i + j) % 2 == 0)


def _copied(d, home, near, c, radius, r):
    """Rows of other cells that are copied to cell c."""
    return np.flatnonzero((home != c) & compares(c, home) & (d[:, c] <= near + 2 * r + _SLACK) & (d[:, c] <= radius[c] + r + _SLACK))


def _copies(pivots, radius, r):
    """The number of vectors copied to each cell, one row for each cell and batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(unit(matrix(batch.column(0))), pivots)
                home, near = d.argmin(1), d.min(1)
                n = [len(_copied(d, home, near, c, radius, r)) for c in range(len(pivots))]
                yield pa.record_batch([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    return run


def _tiles(pivots, radius, blocks, copy_blocks, r):
    """Rows for the tiles of each vector: its home's own block pairs, and those of cells it is copied to."""
    def pieces(home, near, d, key):
        """(rows, cell, low, high, own) of the batch, one tile side after another."""
        for c in range(len(pivots)):
            k, m = blocks[c], copy_blocks[c]
            there = np.flatnonzero(home == c)
            part = (key[there] % np.uint64(k)).astype(np.int64)
            for other in range(k if len(there) else 0):
                yield there, c, np.minimum(part, other), np.maximum(part, other), part
            # Copies of vectors of other cells, in blocks of their own beyond the cell's.
            for other in range(k, k + m if len(there) else 0):
                yield there, c, part, np.full(len(there), other), part
            copied = _copied(d, home, near, c, radius, r)
            part = k + (key[copied] % np.uint64(max(1, m))).astype(np.int64)
            for other in range(k if len(copied) else 0):
                yield copied, c, np.full(len(copied), other), part, part

    def rows(batch, x, held):
        row, low, high, own = (np.concatenate([p[i] for p in held]) for i in (0, 2, 3, 4))
        cell = np.repeat([p[1] for p in held], [len(p[0]) for p in held]).astype(np.int64)
        return pa.record_batch([
            pa.array(cell << 40 | low << 20 | high), pa.array((own == high) & (low != high)),
            batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)),
            pa.array([v.tobytes() for v in x[row]], pa.binary()),
        ], names=["tile", "second", "rep", "copies", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(0)))
            d = _distances(x, pivots)
            home = d.argmin(1)
            near = d[np.arange(len(x)), home]
            rep = batch.column(1).to_numpy()
            key = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            held, size = [], 0
            for piece in pieces(home, near, d, key):
                held.append(piece)
                size += len(piece[0])
                if size >= 20_000:
                    yield rows(batch, x, held)
                    held, size = [], 0
            if held:
                yield rows(batch, x, held)

    return run


def _close(x, y, least):
    """Mask of pairs at or over the cosine: single precision leaves out what is clearly below, doubles decide."""
    rough = x.astype(np.float32) @ y.astype(np.float32).T
    i, j = np.nonzero(rough >= least - 1e-5)
    exact = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return i[exact], j[exact]


def _join(least):
    """Of one tile after another: (rep, links, to) with partial numbers of links, and a forest of them."""
    def tile(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        second = table.column("second").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float64).reshape(len(rep), -1)
        one = np.flatnonzero(~second)
        inner = (table.column("tile")[0].as_py() >> 20 & 0xFFFFF) == (table.column("tile")[0].as_py() & 0xFFFFF)
        two = one if inner else np.flatnonzero(second)
        links = np.zeros(len(rep), np.int64)
        a, b = [], []
        for k in range(0, len(one), 1024):
            part = one[k:k + 1024]
            i, j = _close(x[part], x[two], least)
            i, j = part[i], two[j]
            if inner:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            if len(i):
                u, v = forest(rep[i], rep[j])
                a.append(u)
                b.append(v)
        u, v = forest(np.concatenate(a), np.concatenate(b)) if a else (rep[:0], rep[:0])
        some = np.flatnonzero(links)
        nothing = pa.nulls(len(some), pa.int64())
        return pa.record_batch([
            pa.array(np.concatenate((rep[some], u))), pa.array(np.concatenate((links[some], np.zeros(len(u), np.int64)))),
            pa.concat_arrays([nothing, pa.array(v, pa.int64())])], names=["rep", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key[start] != now:
                    yield tile(held)
                    held = []
                now = key[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield tile(held)

    return run


def range_join(df: DataFrame, least: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of ``df``: id, n_links, component_id, kept.

    Vectors link at a cosine of at least ``least`` in double precision. Null and zero vectors and those with
    null or non-finite components link with nothing, and so do rows without an id, which get a null component
    and are not kept. Equal vectors, and rows of one id, are linked rows of their own. An empty table gives
    no rows. Other columns, labels among them, are never read. Vectors of several lengths are an error.
    """
    spark = df.sparkSession
    found = stage(classes(df, id_col, vector_col), "vectors")
    names = [id_col, "n_links", "component_id", "kept"]
    ids = F.col(f"`{id_col}`").cast("long")
    if one_length(found) is None:
        return df.select(ids, F.lit(0).cast("long"), ids, F.coalesce(ids.isNotNull(), F.lit(False))).toDF(*names)
    sample = hashed_sample(found, "rep", SAMPLE, found.count()).select("vector").toArrow()
    centre = pick_pivots(unit(matrix(sample.column(0).combine_chunks())), pivots)
    cells = found.select("vector").mapInArrow(_homes(centre), "cell int, d double").groupBy("cell").agg(
        F.count("*").alias("n"), F.max("d").alias("radius")).collect()
    radius, blocks = np.zeros(len(centre)), np.ones(len(centre), np.int64)
    for c in cells:
        radius[c["cell"]], blocks[c["cell"]] = c["radius"], max(1, -(-c["n"] // block))
    r = math.sqrt(2 - 2 * least)
    copy_blocks = [0] * len(centre)
    for c in found.select("vector").mapInArrow(_copies(centre, radius, r), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        copy_blocks[c["cell"]] = -(-c["n"] // block)
    tiles = found.select("vector", "rep", "copies").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(
        _tiles(centre, radius, blocks.tolist(), copy_blocks, r), "tile long, second boolean, rep long, copies long, x binary")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "second", "rep")
    out = stage(tiles.mapInArrow(_join(least), "rep long, links long, to long"), "links")
    number = out.where("to IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(out.where("to IS NOT NULL").select("rep", "to"), "groups")
    table = found.join(number, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    rows = df.select(ids.alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    joined = rows.join(table, (rows["v"] == table["vector"]) & rows["id"].isNotNull(), "left")
    component = F.coalesce("c", "id")
    return joined.select("id", F.coalesce("n", F.lit(0)).cast("long"), component, F.coalesce(component == F.col("id"), F.lit(False))).toDF(*names)
