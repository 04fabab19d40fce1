"""Compression classifier: a text compresses better with a dictionary of texts like it.

Two zstandard dictionaries are trained on whole good and whole bad labelled texts. A text's feature is the
difference of its compressed sizes under the two, divided by its own size; a logistic curve fitted on
labelled texts that are in neither dictionary turns it into a probability.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts of each class that a fit reads, and the bytes of a dictionary: the bound of what reaches the driver.
SAMPLE = 2000
DICTIONARY = 1 << 18
LEVEL = 3
#: A text longer than this is compressed in blocks of this size; sizes are summed over the whole text.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float


@functools.lru_cache(maxsize=8)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    book = zstandard.ZstdCompressionDict(content)
    book.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_dict_id=False)


def _size(content: bytes, data: bytes) -> int:
    return sum(len(_compressor(content).compress(data[k:k + BLOCK])) for k in range(0, len(data), BLOCK))


def feature(model: Model, text: str | None) -> float:
    """(size with the bad dictionary - size with the good one) / own size; 0 for null and empty texts."""
    data = (text or "").encode()
    return (_size(model.bad, data) - _size(model.good, data)) / len(data) if data else 0.0


def probability(model: Model, x: float) -> float:
    z = model.slope * x + model.shift
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary; too few or too uniform texts to train on serve as they are."""
    raw = [t.encode() for t in texts]
    try:
        return zstandard.train_dictionary(size, raw).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(raw)[-size:] or b"\n"


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift by Newton's method, label 1 weighted to ``share``, with a small penalty on the slope."""
    if len(set(y.tolist())) < 2:
        return 0.0, 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    scale = float(np.abs(x).std() + np.abs(x).mean()) or 1.0
    a = np.stack((x / scale, np.ones(len(x))), 1)
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (weight * (y - p)) - np.array([1e-2 * beta[0], 0])
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id",
        sample: int = SAMPLE, dictionary: int = DICTIONARY, share: float | None = None) -> Model:
    """Fit on at most ``sample`` texts of each class, those whose ids hash lowest; half of them calibrate.

    ``share`` is that of label 1 among all labelled rows, which the curve is calibrated to; by default that
    of the rows given.

    Rows with a null text, id or label, or another label than 0 and 1, teach nothing. With one class only
    the score is constant; without any it is 0.5.
    """
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL AND text != '' AND label IN (0, 1)")
    book: dict[int, list[str]] = {}
    held: list[tuple[str, int]] = []
    for label in (0, 1):
        picked = rows.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id", "text").limit(sample).select("text").toArrow()
        texts = picked.column(0).to_pylist()
        book[label] = texts[::2]
        held += [(t, label) for t in texts[1::2]]
    model = Model(_dictionary(book[1], dictionary), _dictionary(book[0], dictionary), 0.0, 0.0)
    x = np.array([feature(model, t) for t, _ in held])
    if share is None:
        share = rows.agg(F.avg("label")).first()[0] or 0.5
    slope, shift = _logistic(x, np.array([y for _, y in held]), share)
    return Model(model.good, model.bad, slope, shift)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` and the probability of label 1; only the text is looked at.

    Null and empty texts get the curve's value at 0. A column named ``score_col`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of a fixed size
    kept = [c for c in df.columns if c != score_col]
    names = [f"_{k}" for k in range(len(kept))]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [probability(m, feature(m, t.as_py())) for t in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "_score"])

    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema), "_score double"])
    return inner.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("_score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``labels.quality`` of the rows that are not held out; equal labels of one document count once."""
    known = labels.where(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IN (0, 1)").distinct()
    # Choose ids before texts are touched: texts of the bounded sample alone are gathered.
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    share = known.agg(F.avg("label")).first()[0] or 0.5
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample narrow rows
    return fit(texts, id_col="doc_id", sample=sample, share=share)
