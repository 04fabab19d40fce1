"""Bounded-space online best-fit packing of token pieces into sequences of fixed length.

Each pack of pieces is dealt to one task, which keeps at most ``open_bins`` bins open. A bitset has a bit for
each amount of free space that some open bin has; the lowest bit at or above a piece's length is the best fit.
When too many bins are open, the fullest closes. What is still open at the end of a pack is merged with that
of other packs: open bins are items of the next level, 32 packs to one, until one pack is left.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import PATTERN, Encoder, batches_of_texts, byte_letters, is_stable, vocabulary
from llm.common import stage

LENGTH = 1024
END = 2
OPEN_BINS = 512
PACK = 20_000
LONG_BLANK = 50_000
_BLANK = re.compile(r"\s+")


class BestFit:
    """Online best-fit with a bounded number of open bins."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS):
        self.length, self.most = length, open_bins
        self.free: list[list[int]] = [[] for _ in range(length + 1)]
        self.bits, self.open, self.made = 0, 0, 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin a piece of 1 to ``length`` goes to, and its place there."""
        above = self.bits >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            bins = self.free[room]
            b = bins.pop()
            if not bins:
                self.bits &= ~(1 << room)
        else:
            room, b = self.length, self.made
            self.made += 1
            self.open += 1
        rest = room - size
        if rest:
            self.free[rest].append(b)
            self.bits |= 1 << rest
        else:
            self.open -= 1
        if self.open > self.most:
            fullest = (self.bits & -self.bits).bit_length() - 1
            bins = self.free[fullest]
            bins.pop()
            if not bins:
                self.bits &= ~(1 << fullest)
            self.open -= 1
        return b, self.length - room

    def still_open(self) -> dict[int, int]:
        """Open bins and what they hold."""
        return {b: self.length - room for room, bins in enumerate(self.free) for b in bins}


# -- pieces -----------------------------------------------------------------------------------------------

@functools.lru_cache(maxsize=4)
def _fast(path: str):
    """A faster encoder over the same vocabulary, and the special tokens that it does not know."""
    import tiktoken

    letters = byte_letters()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items()}
    special = [t["content"] for t in spec["added_tokens"]]
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


@functools.lru_cache(maxsize=4)
def _exact(path: str, special: bool) -> Encoder:
    return Encoder(vocabulary(path), 20_000, special=special)


def token_ids(path: str, text: str, special: bool = True) -> np.ndarray:
    """Ids as the tokenizers library gives them, without added special tokens.

    Texts with special tokens (unless those are plain text), with characters that Unicode tables class
    differently, or with white space so long that the fast encoder's search runs out of room, take another encoder.
    """
    fast, tokens = _fast(path)
    long = len(text) > LONG_BLANK and any(m.end() - m.start() > LONG_BLANK for m in _BLANK.finditer(text))
    if not long and is_stable(text) and not (special and any(s in text for s in tokens)):
        return fast.encode_to_numpy(text)
    return _exact(path, special).encode_batch([text])[0].astype(np.uint32)


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens: whole unless longer; then the first may be shorter."""
    first = n % length
    return [first] * bool(first) + [length] * (n // length)


_PIECES = "uid long, doc_id long, piece int, start long, length long, ids array<int>"


def _pieces(path: str, length: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for texts in batches_of_texts([t or "" for t in batch.column(2).to_pylist()], 1 << 22):
                rows = []
                for text in texts:
                    ids = np.append(token_ids(path, text).astype("<u4"), np.uint32(end))
                    sizes = piece_lengths(len(ids), length)
                    for k, (n, start) in enumerate(zip(sizes, accumulate(sizes, initial=0), strict=False)):
                        part = ids[start:start + n]
                        rows.append((uids[at], docs[at], k, start, n, zlib.crc32(part.tobytes()),
                                     part.view(np.int32) if with_ids else None))
                    at += 1
                names = ["uid", "doc_id", "piece", "start", "length", "crc", "ids"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                columns = zip(*rows, strict=True) if rows else [()] * 7
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def cut_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of whole documents: uid (of the row), doc_id, piece, start, length, ids_crc32, ids.

    A document is its token ids and ``end``; null and empty texts are ``end`` alone. Rows with equal or null
    ids are documents of their own, told apart by uid. ``with_ids=False`` leaves ids null.
    """
    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"))
    return source.mapInArrow(_pieces(path, length, end, with_ids), _PIECES.replace("ids ", "ids_crc32 long, ids "))


# -- packing ----------------------------------------------------------------------------------------------

def _pack(length: int, open_bins: int):
    """One pack after another; rows come sorted by pack. Adds bin, offset; one more row for each bin left open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, now = None, None

        def left():
            fill = bins.still_open()
            n = len(fill)
            return pa.record_batch([
                pa.array([now] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(fill.values()), pa.int64()),
                pa.array([now << 32 | b for b in fill], pa.int64()), pa.nulls(n, pa.int64()),
            ], names=["pack", "item", "size", "bin", "offset"])

        for batch in batches:
            placed = []
            for pack, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if pack != now:
                    if bins is not None:
                        yield left()
                    bins, now = BestFit(length, open_bins), pack
                b, offset = bins.put(size)
                placed.append((now << 32 | b, offset))
            if placed:
                b, offset = zip(*placed, strict=True)
                yield pa.record_batch([*batch.columns[:3], pa.array(b, pa.int64()), pa.array(offset, pa.int64())],
                                      names=["pack", "item", "size", "bin", "offset"])
        if bins is not None:
            yield left()

    return run


_PLACED = "pack long, item long, size long, bin long, offset long"


def _placed(items: DataFrame, packs: int, level: int, length: int, open_bins: int) -> DataFrame:
    """items: item, size. Deals them to packs by hash; each pack is one run of a task's sorted rows."""
    base = level << 26
    dealt = items.select((F.pmod(F.xxhash64("item", F.lit(level)), F.lit(packs)) + base).alias("pack"), "item", "size")
    dealt = dealt.repartition(max(1, packs), "pack").sortWithinPartitions("pack", F.xxhash64("item"))
    return stage(dealt.mapInArrow(_pack(length, open_bins), _PLACED), "packs")


def pack(items: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """items: item (unique long), size (1 to length). Returns item, sequence_id, offset.

    The number of packs follows the number of items, ``PACK`` items to each, so tasks stay bounded.
    """
    packs = max(1, -(-items.count() // PACK))
    placed = _placed(items, packs, 0, length, open_bins)
    final = placed.where("item IS NOT NULL").select("item", "bin", "offset")
    level = 0
    while packs > 1:
        level += 1
        packs = -(-packs // 32)
        rest = placed.where("item IS NULL").select(F.col("bin").alias("item"), "size")
        placed = _placed(rest, packs, level, length, open_bins)
        moved = placed.where("item IS NOT NULL").select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        final = final.join(moved, "bin", "left").select(
            "item", F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
    return final.withColumnRenamed("bin", "sequence_id")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, open_bins: int = OPEN_BINS,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of ``cut_documents`` (without uid) with sequence_id and offset, the place in the sequence.

    An empty table gives no rows. Ties between bins of equal free space go to the one used last; the dealing
    is by row number, so a rerun over the same files gives the same sequences. Pieces are staged once, so
    tokens, packing and the result agree even if a task runs again.
    """
    pieces = stage(cut_documents(docs, path, length, end, id_col, text_col, with_ids).withColumn(
        "item", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.select("item", F.col("length").alias("size")), length, open_bins)
    return pieces.drop("uid").join(places, "item").drop("item")
