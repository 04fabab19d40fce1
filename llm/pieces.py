"""SentencePiece BPE by a table of distinct chunks.

No piece of such a model has a whitespace marker behind another character, so merging never crosses from a
character to a marker: a text falls into marked words, each markers and what follows them. A worker keeps a
table of the chunks it has met; each new one is segmented once, by the library, and a text's ids are its
chunks' ids in order of position. Line feeds, where no longer piece holds one, part chunks as well.
"""

from __future__ import annotations

import codecs
import functools
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import batches_of_texts

MARK = "▁"
_CACHED, _CACHED_CHARS, _LONG = 200_000, 1 << 23, 256


def _one_by_one(error):
    return "�", error.start + 1


codecs.register_error("llm.one_by_one", _one_by_one)


class PieceModel:
    """Pieces of a model file; models whose pieces cross markers or that rewrite texts are refused."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        pieces = [model.id_to_piece(k) for k in every]
        self.end, self.unknown = model.eos_id(), model.unk_id()
        other = np.array([model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in every])
        plain = np.flatnonzero(~other).tolist()
        if any(MARK in pieces[k].lstrip(MARK) for k in plain):
            raise ValueError("pieces cross whitespace markers")
        if model.normalize(" a  ÅＡ\n ") != f"{MARK}{MARK}a{MARK}{MARK}ÅＡ\n{MARK}":
            raise ValueError("the model rewrites texts")
        self.bytes: list[bytes] = [b""] * len(every)
        for k in every:
            if model.is_byte(k):
                self.bytes[k] = bytes([int(pieces[k][1:-1], 16)])
            elif not other[k]:
                self.bytes[k] = pieces[k].replace(MARK, " ").encode()
        self.bytes[self.unknown] = " ⁇ ".encode()
        self.objects = np.array(self.bytes, object)
        self.control = np.array([model.is_control(k) for k in every])
        self.marked = np.zeros(len(every), bool)
        self.marked[[k for k in plain if pieces[k].startswith(MARK)]] = True
        alone = "" if any("\n" in pieces[k] for k in plain if len(pieces[k]) > 1) else "\n"
        self._chunk = re.compile(("\n|" if alone else "") + f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+")
        self._feed = len(model.encode("\n"))

    def chunks(self, text: str) -> list[str]:
        """Marked words of a text in order; the text gets a marker in front."""
        return self._chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. The library puts a marker in front; where a chunk has none, a line feed parts them."""
        marked = [c[:1] == MARK for c in chunks]
        found = self.library.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked, strict=True)], num_threads=1)
        # A marker alone is an empty text to the library, which gives it no pieces.
        lone = self.library.piece_to_id(MARK)
        return [(ids or [lone]) if m else ids[self._feed:] for ids, m in zip(found, marked, strict=True)]

    def decode(self, ids) -> str:
        """The text of ids: controls are silent, one marker goes from the front, bytes that are no UTF-8 are replaced."""
        ids = np.asarray(ids, np.int64)
        silent = np.flatnonzero(self.control[ids])
        said = np.delete(ids, silent)
        if not len(said):
            return ""
        raw = self.objects[said].tolist()
        if self.marked[said[0]]:
            raw[0] = raw[0][1:]
        cuts = [0, *(silent - np.arange(len(silent))).tolist(), len(raw)]  # a control parts the bytes of a character
        return "".join(b"".join(raw[a:b]).decode("utf-8", "llm.one_by_one") for a, b in pairwise(cuts))


@functools.lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


class ChunkTable:
    """Ids of distinct chunks as bytes, bounded in entries and characters; it starts anew when full."""

    def __init__(self, model: PieceModel, cached: int = _CACHED, chars: int = _CACHED_CHARS):
        self.model, self.cached, self.chars = model, cached, chars
        self.known, self.held = {}, 0

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > self.cached or self.held > self.chars:
            self.known, self.held = {}, 0
        split = [self.model.chunks(t) for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known)) if split else []
        found = self.model.segment(new)
        ends = np.cumsum([0, *map(len, found)]) * 4
        flat = array("i", chain.from_iterable(found)).tobytes()
        known.update((c, flat[a:b]) for c, (a, b) in zip(new, pairwise(ends.tolist()), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, chunks)), np.int32) for chunks in split]
        for c in new:
            if len(c) > _LONG:
                del known[c]
            else:
                self.held += len(c)
        return out


@functools.lru_cache(maxsize=4)
def chunk_table(path: str) -> ChunkTable:
    """One for each worker process."""
    return ChunkTable(piece_model(path))


def _mapped(df: DataFrame, in_col: str, out_col: str, kind: str, arrow: pa.DataType, make: Callable[[pa.Array], list]) -> DataFrame:
    """All columns of ``df`` and one made from another, whatever their names; ``out_col`` is replaced."""
    kept = [c for c in df.columns if c != out_col]
    names = [f"_{k}" for k in range(len(df.columns))]
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
    at, held = df.columns.index(in_col), [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(k) for k in held), pa.array(make(batch.column(at)), arrow)],
                                  names=[*(names[k] for k in held), "_made"])

    fields = [inner.schema[k] for k in held]
    out = inner.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), f"_made {kind}"]))
    return out.select(*[F.col(f.name).alias(c) for f, c in zip(fields, kept, strict=True)], F.col("_made").alias(out_col))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", end: bool = False) -> DataFrame:
    """All columns of ``df`` and the ids of its whole texts as ``array<int>``, with the end id where asked.

    Null and empty texts have no pieces. Strings of special pieces in a text are plain text. Other columns
    pass unchanged; one named ``ids_col`` is replaced. Rows are independent, so order and repetition don't
    matter, and an empty table stays empty.
    """
    def ids(column: pa.Array) -> list:
        table = chunk_table(path)
        tail = np.array([table.model.end] * end, np.int32)
        return [np.append(x, tail) for texts in batches_of_texts([t or "" for t in column.to_pylist()]) for x in table.encode_batch(texts)]

    return _mapped(df, text_col, ids_col, "array<int>", pa.list_(pa.int32()), ids)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of its ids; null ids give an empty text, unknown ids an error."""
    def texts(column: pa.Array) -> list:
        model = piece_model(path)
        return [model.decode(x.values.to_numpy() if x.is_valid else ()) for x in column]

    return _mapped(df, ids_col, text_col, "string", pa.string(), texts)
