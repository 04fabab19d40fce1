"""N-gram Jaccard join: size-banded tiles with bitmap signatures, then exact intersection of sorted arrays.

Two texts link when ``100 * |A and B| >= 80 * |A or B|`` for their sets of distinct five-word shingles.

1. Texts with the same words are one class; only classes go on.
2. Any two sets that link share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, under any common
   order of shingles. The order puts frequent shingles last, so common lines and passages hardly appear in
   these prefixes. How frequent a shingle is only decides the order, never the result.
3. A tile holds the classes that share one prefix shingle, in order of size; only neighbours within the
   size band (5 to 4) meet. Tiles over ``block`` rows are cut into pairs of blocks. In a tile, the bits that
   differ between two parity bitmaps bound the overlap from above; what fails the bound is dropped.
4. Survivors are verified on sorted arrays in two rounds. The first takes one partner for each class and
   tile. Pairs whose classes it connected need no check, so large groups of copies cost no pairs; the second
   round verifies all other survivors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import components, drop_staged, stage
from llm.shingles import hashed

PERCENT = 80
BLOCK = 2048
#: Least bits of a bitmap for each shingle; at 1 a pair that shares less than 0.74 fails the bound, as a rule.
BITS = 1
#: Bits of the filter on ids that spares the texts that are in no pair; its size does not depend on the input.
FILTER = 1 << 22
FREQUENT = 1 << 19


def prefix_length(n: np.ndarray | int):
    """Shingles of a set of n that must hold one of every set it links with."""
    return n - (PERCENT * n + 99) // 100 + 1


def bitmap_bits(n: int) -> int:
    """A power of two of one to two bits a shingle and more, so one band of sizes has one or two widths."""
    return max(64, 1 << math.ceil(math.log2(max(n, 1) * BITS)))


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of shingles has i in its lowest bits."""
    bits = bitmap_bits(len(shingles))
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _digest(words: np.ndarray) -> bytes:
    return hashlib.md5(words.tobytes()).digest()


# -- frequent shingles ------------------------------------------------------------------------------------

def _locally_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that at least three different texts of a run of batches share, with that number."""
    def counted(sets):
        value, n = np.unique(np.concatenate(sets), return_counts=True)
        keep = n >= 3
        return pa.record_batch([value[keep].view(np.int64), n[keep].astype(np.int64)], names=["shingle", "n"])

    sets, held, seen = [], 0, set()
    for batch in batches:
        for words, shingles in hashed(batch.column(0)):
            if len(shingles) and (mark := _digest(words)) not in seen:
                seen.add(mark)
                sets.append(shingles)
                held += len(shingles)
            if held > 2_000_000:
                yield counted(sets)
                sets, held, seen = [], 0, set()
    if sets:
        yield counted(sets)


def frequent_shingles(texts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, sorted by shingle; at most ``most``, whatever the input.

    The bound limits what is sent to tasks (16 bytes each). It bears on the order of shingles only.
    """
    counts = stage(texts.mapInArrow(_locally_frequent, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n")), "frequent")
    steps = counts.groupBy(F.floor(F.log2("n") * 4).alias("step")).count().collect()
    least, room = 0, most
    for step in sorted(steps, key=lambda r: -r["step"]):
        room -= step["count"]
        if room < 0:
            least = step["step"] + 1
            break
    kept = counts.where(F.floor(F.log2("n") * 4) >= least).toArrow()
    drop_staged(counts)
    value = kept.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(value)
    return value[order], kept.column("n").to_numpy()[order]


# -- sets, prefixes and bitmaps ---------------------------------------------------------------------------

_PROFILE = "id long, uid long, n long, digest binary, keys array<long>, bitmap binary"


def _profiles(frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, count = frequent.value
        for batch in batches:
            n, digests, keys, bitmaps, seen = [], [], [], [], set()
            has_id = batch.column(0).is_valid().to_pylist()
            for words, shingles in hashed(batch.column(2)):
                mark = _digest(words) if len(shingles) else None
                n.append(len(shingles))
                digests.append(mark)
                if mark is None or mark in seen or not has_id[len(n) - 1]:
                    keys.append(None)
                    bitmaps.append(None)
                    continue
                seen.add(mark)
                at = np.searchsorted(value, shingles)
                at[at == len(value)] = 0
                known = value[at] == shingles if len(value) else np.zeros(len(shingles), bool)
                rank = np.where(known, count[at], 0) if len(value) else np.zeros(len(shingles), np.int64)
                # Shingles are sorted already, so a stable sort orders by (frequency, shingle).
                order = np.argsort(rank, kind="stable")[:prefix_length(len(shingles))]
                keys.append(shingles[order].view(np.int64))
                bitmaps.append(parity_bitmap(shingles))
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary()),
            ], names=["id", "uid", "n", "digest", "keys", "bitmap"])

    return run


# -- tiles ------------------------------------------------------------------------------------------------

def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and size, those that meet another of their key within the size band; state is one row.

    In order of size, a row meets any other only if it meets one of its neighbours.
    """
    last = None  # the row before, and whether it has been passed on
    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, rep = (batch.column(c).to_numpy() for c in range(3))
        if last is not None:
            key, n, rep = np.append(last[0], key), np.append(last[1], n), np.append(last[2], rep)
        same = (key[1:] == key[:-1]) & (n[1:] <= n[:-1] * 100 // PERCENT)
        keep = np.append(False, same) | np.append(same, False)
        if last is not None and last[3]:
            keep[0] = False
        passed = bool(keep[-1]) or (len(key) == 1 and last is not None and last[3])
        yield pa.record_batch([key[keep], rep[keep]], names=["key", "rep"])
        last = (key[-1], n[-1], rep[-1], passed)
    return


def _widths(bitmaps: list[bytes]):
    """Bitmaps by width: width -> (matrix, row of each bitmap in it or -1), halves of wider ones included."""
    sizes = np.array([len(x) // 8 for x in bitmaps])
    out = {}
    for width in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == width)
        wide = np.flatnonzero(sizes == 2 * width)
        place = np.full(len(bitmaps), -1)
        place[own] = np.arange(len(own))
        place[wide] = np.arange(len(own), len(own) + len(wide))
        words = np.frombuffer(b"".join([bitmaps[k] for k in own]), np.uint64).reshape(-1, width)
        if len(wide):
            # Halves are xor-ed, which keeps parities for half as many bits.
            more = np.frombuffer(b"".join([bitmaps[k] for k in wide]), np.uint64).reshape(-1, 2, width)
            words = np.concatenate((words, more[:, 0] ^ more[:, 1]))
        out[width] = words, place
    return sizes, out


def _partners(tile, n, comp, block, alone, bitmaps):
    """Pairs of rows that may link: one tile, size band, different components, and the bitmaps' bound.

    Rows are in order of (tile, size). Row i meets rows i + 1, i + 2, ... of its band, one distance at a time
    for all rows. In a tile of two different blocks only rows of different blocks meet.
    """
    order = tile * (1 << 40)
    top = np.searchsorted(order + n, order + n * 100 // PERCENT, "right")
    sizes, by_width = _widths(bitmaps)
    active, step = np.arange(len(n)), 1
    while len(active := active[active + step < top[active]]):
        i = active[(comp[active] != comp[active + step]) & (alone[active] | (block[active] != block[active + step]))]
        for width in np.unique(sizes[i]).tolist():
            words, place = by_width[width]
            x = i[sizes[i] == width]
            y = x + step
            differ = np.bitwise_count(words[place[x]] ^ words[place[y]]).sum(1, dtype=np.int64)
            total = n[x] + n[y]
            overlap = (total - differ) // 2
            ok = 100 * overlap >= PERCENT * (total - overlap)
            if ok.any():
                yield x[ok], y[ok], differ[ok] / total[ok]
        step += 1


def _best(survivors, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the earlier partner that differs least; for a row without any pair so far, the later one.

    Where all rows of a tile link, these pairs connect them all.
    """
    to = np.full((2, rows), -1)
    least = np.full((2, rows), np.inf)
    for i, j, differ in survivors:
        for side, (x, y) in enumerate(((j, i), (i, j))):
            better = differ < least[side][x]
            to[side][x[better]] = y[better]
            least[side][x[better]] = differ[better]
    j = np.flatnonzero(to[0] >= 0)
    i = to[0][j]
    alone = to[1] >= 0
    alone[i] = alone[j] = False
    more = np.flatnonzero(alone)
    return np.concatenate((i, more)), np.concatenate((j, to[1][more]))


_TILE = ("key", "low", "high")


def _tiles(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of one tile after another; rows come sorted by tile, then by size.

    ``every`` gives all survivors between components, otherwise one surviving partner for each class. Whole
    tiles of a batch are handled together; the last one waits for its next rows, twice ``BLOCK`` or so at most.
    """
    def pairs(table: pa.Table) -> pa.RecordBatch:
        key, low, high, block, rep, n, comp = (table.column(c).to_numpy() for c in (*_TILE, "block", "rep", "n", "comp"))
        new = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        tile = np.cumsum(new)
        a, b = [rep[:0]], [rep[:0]]
        survivors = _partners(tile, n, comp, block, low == high, table.column("bitmap").to_pylist())
        if every:
            for i, j, _ in survivors:
                a.append(rep[i])
                b.append(rep[j])
        else:
            i, j = _best(survivors, len(n))
            a.append(rep[i])
            b.append(rep[j])
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        return pa.record_batch([found[:, 0].copy(), found[:, 1].copy()], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        tile = [held.column(c).to_numpy() for c in _TILE]
        last = np.flatnonzero(np.any([x != x[-1] for x in tile], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield pairs(held.slice(0, cut))
            held = held.slice(cut)
    if held is not None:
        yield pairs(held)


def _candidates(rows: DataFrame, marks: DataFrame, every: bool) -> DataFrame:
    """rows: key, rep, comp; marks: rep, n, bitmap. Distinct pairs that survive the bound in any tile.

    Tiles are dealt while rows are narrow. One of more than ``BLOCK`` rows becomes all pairs of its blocks,
    and a row goes to each pair that its block is part of.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("_rows"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    counts = counts.where("_lo != _hi").select("key", F.ceil(F.col("_rows") / BLOCK).cast("int").alias("_k"))
    dealt = rows.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(
        "key", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "rep", "comp")
    tiles = dealt.join(marks.select("rep", "n", "bitmap"), "rep").repartition(*_TILE).sortWithinPartitions(
        *_TILE, "n", "rep").select(*_TILE, "block", "rep", "n", "comp", "bitmap")
    return tiles.mapInArrow(lambda b: _tiles(b, every), "a long, b long").distinct()


# -- verification -----------------------------------------------------------------------------------------

def _id_filter(ids: DataFrame) -> np.ndarray:
    """Which of ``FILTER`` remainders the ids leave; ORed in 64-bit words before they reach the driver."""
    rest = F.pmod(F.col("id"), F.lit(FILTER))
    words = ids.select(F.floor(rest / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(id, {FILTER}) % 64 AS int))").alias("b"))
    out = np.zeros(FILTER // 64, np.int64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        out[row["w"]] = row["b"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sets(shared):
    """Id, digest and sorted shingle array of each text that passes the filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            batch = batch.filter(pa.array(wanted[np.mod(ids, FILTER)] & batch.column(0).is_valid().to_numpy(zero_copy_only=False)))
            marks, sets = [], []
            for words, shingles in hashed(batch.column(1)):
                marks.append(_digest(words))
                sets.append(shingles.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(marks, pa.binary()), pa.array(sets, pa.binary())], names=["id", "digest", "shingles"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            small, large = (one, two) if len(one) < len(two) else (two, one)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            keep.append(100 * both >= PERCENT * (len(one) + len(two) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    first = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


# -- the operator -----------------------------------------------------------------------------------------

def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: ``id``, ``n_shingles``, ``component_id`` (the least id reachable by links).

    Null, empty and blank texts have no shingles and link with nothing; fewer than five words count as one
    shingle. Rows without an id link with nothing and get a null component. Rows with equal ids are one
    document: a link of either joins both. An empty table gives no rows. Other columns are never read.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(source.select("text")))
    profile = stage(source.select("id", F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(
        _profiles(frequent), _PROFILE), "profiles")

    # A class of equal word sequences goes by the uid of one row that carries its prefix and bitmap.
    slim = stage(profile.select("id", "n", "digest"), "members")
    members = slim.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = profile.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("least"), F.min(F.when(F.col("keys").isNotNull(), F.col("uid"))).alias("uid"))
    classes = stage(classes.withColumnRenamed("uid", "rep"), "classes")
    rich = profile.where("keys IS NOT NULL").join(
        classes.select("digest", F.col("rep").alias("uid")), ["digest", "uid"]).withColumnRenamed("uid", "rep")
    marks = stage(rich.select("rep", "id", "digest", "n", "bitmap"), "bitmaps")
    keyed = rich.select(F.explode("keys").alias("key"), "n", "rep").repartition("key").sortWithinPartitions("key", "n", "rep")
    shared = stage(keyed.mapInArrow(_runs, "key long, rep long"), "runs")
    drop_staged(profile)

    first = stage(_candidates(shared.withColumn("comp", F.col("rep")), marks, False), "pairs")
    paired = first.select(F.col("a").alias("rep")).union(first.select("b")).distinct()
    wanted = stage(marks.join(paired, "rep", "left_semi").select("id", "digest", "rep"), "wanted")
    passing = spark.sparkContext.broadcast(_id_filter(wanted))
    sets = source.mapInArrow(_sets(passing), "id long, digest binary, shingles binary").join(
        wanted, ["id", "digest"]).select("rep", "shingles")
    sets = stage(sets.dropDuplicates(["rep"]), "sets")
    links = stage(_links(first, sets), "links")
    groups = components(links, "groups")

    # Second round: what the first has not connected.
    rest = shared.join(paired, "rep", "left_semi").join(
        groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp"))
    more = _links(_candidates(rest, marks, True), sets)
    final = components(links.union(more).union(_same_id(members, classes)), "final")

    node = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", "least", F.coalesce("component", "rep").alias("component"))
    label = node.join(node.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(
        "digest", "component_id")
    return slim.join(label, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def _same_id(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes that rows of one id belong to, where there are several."""
    several = members.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi")
    by_class = members.join(several.select("id", "lo"), "id").select("digest", "lo").distinct()
    own = by_class.join(classes.select("digest", "rep"), "digest")
    return own.join(classes.select(F.col("digest").alias("lo"), F.col("rep").alias("other")), "lo").select("rep", "other")
