"""Comparable doubles for the two sides of a check.

Means over a few two-decimal readings fall exactly between two rounded values all the time, and the
last bit of a sum depends on its order. The checks therefore cut doubles at a place no such value can
reach: ``floor(x * 10^d + 0.5123) / 10^d``. Only the registered queries do this; the operators do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHIFT = 0.5123


def snap(column: Column, digits: int = 6) -> Column:
    factor = float(10 ** digits)
    return F.floor(column * factor + SHIFT) / factor


def sql(expression: str, digits: int = 6) -> str:
    factor = f"CAST(1e{digits} AS DOUBLE)"
    return f"floor(({expression}) * {factor} + {SHIFT}) / {factor}"


def snapped(df: DataFrame, **digits: int) -> DataFrame:
    """Snap every double column and show every timestamp and date as text."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind == "double":
            column = snap(column, digits.get(field.name, 6))
        elif kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            column = F.date_format(column, "yyyy-MM-dd")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)
