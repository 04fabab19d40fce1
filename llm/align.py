"""Cross-tokenizer alignment by runs on a diagonal.

Two tokenizers cut the same bytes. Where the ends of their tokens agree one to one, both end arrays are equal
along a diagonal: position i of one and i + shift of the other. Probes of doubling length jump such runs; where
a probe fails, halving finds the first difference, the irregular group there is resolved token by token until
both ends meet, and its tokens change the shift. Every pair of overlapping tokens is met on the way.

How many documents hold a pair is counted over blocks of documents: a block's first row carries its different
pairs, only those are counted and looked up, and they meet their documents again block by block.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import bpe, packing, pieces
from llm.common import stage

#: Short runs are walked, longer ones probed.
NEAR = 16
#: A block of documents ends after so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 500, 1 << 21


def irregular_steps(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Pairs of overlapping tokens that do not end together, from the byte ends of two cuts of the same bytes."""
    steps_a, steps_b = [], []
    i, shift, n = 0, 0, len(a)
    while True:
        near = min(i + NEAR, n)
        while i < near and a[i] == b[i + shift]:
            i += 1
        if i == near and i < n:
            probe = NEAR
            while i < n and a[i:i + probe] == b[i + shift:i + shift + probe]:
                i += probe
                probe *= 2
            while probe > 1:
                probe //= 2
                if a[i:i + probe] == b[i + shift:i + shift + probe]:
                    i += probe
        if i >= n:
            return steps_a, steps_b
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            steps_a.append(i)
            steps_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        shift = j - i


class Alignment:
    """Groups and links of two lists of tokens of the same bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.a, self.b, self.ends_a = a, b, ends_a
        steps = [np.array(x, np.int64) for x in irregular_steps(ends_a.tolist(), ends_b.tolist())]
        moved = ends_a[steps[0]] < ends_b[steps[1]]
        self.last_a, self.last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        self.last_a[steps[0][moved]] = False
        self.last_b[steps[1][~moved]] = False
        self.at_a, self.at_b = np.flatnonzero(self.last_a), np.flatnonzero(self.last_b)
        self.link_a, self.link_b = np.concatenate((self.at_a, steps[0])), np.concatenate((self.at_b, steps[1]))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Different linked id pairs, A in the high half, and how often each is linked."""
        key = self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b]
        return np.unique(key, return_counts=True)

    def listing(self, say_a: np.ndarray, say_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``; the words of each id with ``,`` and with its closing mark at 2 * id and 2 * id + 1."""
        before_a, before_b = self.at_a + 1, np.concatenate(([0], self.at_b[:-1] + 1))
        group_a, group_b = (np.cumsum(x) - x for x in (self.last_a, self.last_b))
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before_b[group_a]] = say_a[2 * self.a + self.last_a]
        out[np.arange(len(self.b)) + before_a[group_b]] = say_b[2 * self.b + self.last_b]
        return b"".join(out.tolist())[:-1]


class Aligner:
    """Both tokenizers of a worker, and the bytes and decimal forms of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        vocab, model = bpe.vocabulary(path_a), pieces.piece_model(path_b)
        self.path, self.table = path_a, pieces.ChunkTable(model)
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (vocab.bytes, model.bytes))
        self.say_a = np.array([f"{k}{mark}".encode() for k in range(len(vocab.bytes)) for mark in ",|"], object)
        self.say_b = np.array([f"{k}{mark}".encode() for k in range(len(model.bytes)) for mark in ",;"], object)

    def align(self, texts: list[str]) -> list[Alignment | None]:
        """The alignment of each text; None where it is empty or a tokenizer does not keep its bytes.

        Byte-level tokens keep every byte. Pieces lose only markers in the text, which turn into spaces and are
        longer than those, and what they call unknown; both show without a look at the bytes themselves.
        """
        out = []
        for text, b in zip(texts, self.table.encode_batch(texts), strict=True):
            kept = text and pieces.MARK not in text and not (b == self.table.model.unknown).any()
            a = packing.token_ids(self.path, " " + text, special=False).astype(np.int64) if kept else b
            out.append(Alignment(a, b, self.size_a[a].cumsum(), self.size_b[b].cumsum()) if kept else None)
        return out


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _renamed(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str], list[str]]:
    """The columns of docs under numbers, without the text, which comes last as ``_text``."""
    kept = [c for c in docs.columns if c != text_col]
    names = [f"_{k}" for k in range(len(kept))]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text_col}`").alias("_text"))
    return inner, kept, names


def _ddl(df: DataFrame, names: list[str], more: str) -> str:
    return ", ".join([*(f"{n} {df.schema[n].dataType.simpleString()}" for n in names), more])


def token_groups(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and a_ids, b_ids and groups: array of (a_end, b_end, byte_end).

    A group's ends are exclusive positions in a_ids, b_ids and in the UTF-8 of a space and the text. Texts
    that are null or empty, or whose bytes a tokenizer does not keep, have empty arrays.
    """
    inner, kept, names = _renamed(docs, text_col)
    group = pa.struct([("a_end", pa.int32()), ("b_end", pa.int32()), ("byte_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in bpe.batches_of_texts([t or "" for t in batch.column(len(kept)).to_pylist()]):
                found += aligner(path_a, path_b).align(texts)
            ids = [pa.array([getattr(x, side) if x else [] for x in found], pa.list_(pa.int32())) for side in "ab"]
            cuts = [[] if x is None else [dict(zip(("a_end", "b_end", "byte_end"), ends, strict=True)) for ends in zip(
                (x.at_a + 1).tolist(), (x.at_b + 1).tolist(), x.ends_a[x.at_a].tolist(), strict=True)] for x in found]
            yield pa.record_batch([*batch.columns[:len(kept)], *ids, pa.array(cuts, pa.list_(group))], names=[*names, "a_ids", "b_ids", "groups"])

    ddl = _ddl(inner, names, "a_ids array<int>, b_ids array<int>, groups array<struct<a_end:int,b_end:int,byte_end:bigint>>")
    out = inner.mapInArrow(run, ddl)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "a_ids", "b_ids", "groups")


_MEASURES = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_BLOCK = [("block", pa.int64()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
          ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}


def _aligned(path_a: str, path_b: str, names: list[str]):
    """Measures of each row and its different pairs, as places in those of its block; the first row of a block lists them."""
    width = len(names)

    def blocks(batches):
        """Slices of the batches within the bounds of a block."""
        for batch in batches:
            texts = [t or "" for t in batch.column(width).to_pylist()]
            start = 0
            for part in bpe.batches_of_texts(texts, BLOCK_CHARS):
                for k in range(0, len(part), BLOCK_ROWS):
                    now = part[k:k + BLOCK_ROWS]
                    yield batch.slice(start, len(now)), now
                    start += len(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, both = TaskContext.get().partitionId(), aligner(path_a, path_b)
        for number, (rows, texts) in enumerate(blocks(batches)):
            measures, keys, times = [], [], []
            for x in both.align(texts):
                if x is None:
                    measures.append((0, 0, 0, 0, ""))
                    keys.append(np.empty(0, np.int64))
                    times.append(keys[-1])
                else:
                    listing = hashlib.sha256(x.listing(both.say_a, both.say_b)).hexdigest()
                    measures.append((len(x.a), len(x.b), len(x.at_a), len(x.link_a), listing))
                    key, n = x.pairs()
                    keys.append(key)
                    times.append(n)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            pairs, place, docs = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (place, np.concatenate(times))]
            first = [pa.array([x, *[None] * (len(texts) - 1)], kind) for x, kind in ((pairs, pa.list_(pa.int64())), (docs.astype(np.int32), pa.list_(pa.int32())))]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*measures, strict=True), _MEASURES, strict=True)]
            yield pa.record_batch([*rows.columns[:width], *columns, pa.array([task << 32 | number] * len(texts), pa.int64()), *lists, *first],
                                  names=[*names, *(n for n, _ in _MEASURES + _BLOCK)])

    return run


def _weighed(names: list[str]):
    """Looks up the counts of a block's pairs for its rows."""
    def run(rows: pa.Table, counted: pa.Table) -> pa.Table:
        order = np.argsort(counted.column("pair").to_numpy())
        count, top = (counted.column(c).to_numpy()[order] for c in ("count", "top"))
        top = top.astype(bool)
        at, times = rows.column("at").combine_chunks(), rows.column("times").combine_chunks()
        owner = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
        place, n = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        best, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        np.add.at(best, owner, n * top[place])
        np.add.at(total, owner, n * count[place])
        kept = [*names, *(n for n, _ in _MEASURES)]
        return pa.table([*(rows.column(c) for c in kept), pa.array(best), pa.array(total)], names=[*kept, "n_best", "count_sum"])

    return run


def link_statistics(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows that hold it linked; n_best counts links whose count is the highest of
    their A id, ties included. Null and empty texts, and those whose bytes a tokenizer does not keep, have
    zeros and an empty digest. Equal and repeated rows are documents of their own; an empty table gives no rows.
    """
    inner, kept, names = _renamed(docs, text_col)
    fields = ", ".join(f"{n} {_KINDS[t]}" for n, t in _MEASURES + _BLOCK)
    rows = stage(inner.mapInArrow(_aligned(path_a, path_b, names), _ddl(inner, names, fields)), "aligned")
    listed = rows.where("pairs IS NOT NULL").select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(
        "block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = listed.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    info = counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("top"))
    known = listed.select("block", "pair").join(info, "pair").select(F.col("block").alias("of"), "pair", "count", "top")
    body = rows.drop("pairs", "docs")
    ddl = _ddl(inner, names, ", ".join([*(f"{n} {_KINDS[t]}" for n, t in _MEASURES), "n_best long", "count_sum long"]))
    out = body.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_weighed(names), ddl)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)],
                      "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
