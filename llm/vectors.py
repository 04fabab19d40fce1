"""Valid vectors as classes of equal ones, shared by the joins and searches on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(vector: str = "embedding"):
    """A vector takes part if it is not null or empty, all components are finite and one is not zero."""
    c = F.col(vector)
    odd = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(c, lambda x: x != 0)
    return F.coalesce(c.isNotNull() & ~odd & some, F.lit(False))


def classes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(rep, copies, vector): the least id and the number of rows of each different valid vector.

    Equal vectors are combined before the shuffle, so a vector that a third of all rows hold is one row of
    each task. Rows without an id are left out.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & valid("vector"))
    return rows.groupBy("vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64, copy=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def one_length(df: DataFrame, vector: str = "vector") -> int | None:
    """The length of all vectors, or None if there are none."""
    found = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if found[0] != found[1]:
        raise ValueError(f"vectors of {found[0]} to {found[1]} components; one length is needed")
    return found[0]
