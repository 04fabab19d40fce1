"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid import constants as C


def zero_pad(column: Column, width: int) -> Column:
    """Left-pad with zeros, leaving longer text whole (``lpad`` alone would cut it)."""
    return F.when(F.length(column) >= width, column).otherwise(F.lpad(column, width, "0"))


def station_id(state: Column, county: Column, site: Column) -> Column:
    parts = [(state, 2), (county, 3), (site, 4)]
    return F.concat(*(zero_pad(part.cast("string"), width) for part, width in parts))


def parse_hour(date: Column, time: Column) -> Column:
    """``date`` and ``time`` text as a timestamp; null when it cannot be read."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), time), F.lit("yyyy-M-d H:m"))


def not_nan(column: Column) -> Column:
    """NaN becomes null, which is what aggregates and comparisons expect for a missing value."""
    return F.when(~F.isnan(column), column)


def with_json(df: DataFrame, name: str, column: Column | str, schema: T.StructType) -> DataFrame:
    """Add the parsed document, null where the text cannot be read as one.

    Each text is parsed once: unlike a plain column's, a generator's expression is never copied into the filters
    and columns that use it.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(column, full, {"columnNameOfCorruptRecord": "_corrupt"})
    rows = df.select("*", F.explode(F.array(parsed)).alias(name))
    return rows.withColumn(name, F.when(F.col(name)["_corrupt"].isNull(), F.col(name)))


def round_even(column: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of array libraries."""
    factor = float(10 ** digits)
    return F.rint(column * factor) / factor


def choose(column: Column, mapping: dict) -> Column:
    """Literal lookup; null for unknown keys."""
    out = F.lit(None)
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def unit_label(pollutant: Column) -> Column:
    return choose(pollutant, C.UNITS)


def cyclical(column: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * column / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def calendar_features(ts: Column) -> dict[str, Column]:
    """Sine and cosine of hour, Monday-based weekday and month, and the calendar quarter."""
    out: dict[str, Column] = {}
    for name, value, period in (
        ("hour", F.hour(ts), 24), ("dow", F.weekday(ts), 7), ("month", F.month(ts), 12),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(value, period)
    out["season"] = season_quarter(F.month(ts))
    return out


def season_quarter(month: Column) -> Column:
    """Calendar quarter 0..3, the season the models use."""
    return F.floor((month - 1) / 3).cast("int")


def season_meteo(month: Column) -> Column:
    """0 = December to February, 1 = March to May, and so on: the season the exports use."""
    return F.floor((month % 12) / 3).cast("int")


def category(value: Column, pollutant: str) -> Column:
    """Band label of a concentration."""
    label = F.lit(C.ABOVE_ALL_LABEL)
    for limit, name in reversed(list(zip(C.CATEGORY_LIMITS[pollutant], C.CATEGORY_LABELS))):
        label = F.when(value <= limit, F.lit(name)).otherwise(label)
    return F.when(value.isNull() | F.isnan(value), F.lit(C.NO_DATA_LABEL)).otherwise(label)


def clip(value: Column, pollutant: Column, digits: int | None = 4) -> Column:
    """Clamp to the pollutant's physical bounds; a missing value stays missing."""
    low = choose(pollutant, {p: b[0] for p, b in C.BOUNDS.items()})
    high = choose(pollutant, {p: b[1] for p, b in C.BOUNDS.items()})
    held = F.greatest(low, F.least(high, value))
    held = round_even(held, digits) if digits is not None else held
    return F.when(not_nan(value).isNotNull(), held)


def census_region(state: Column) -> Column:
    """Census region of a state name."""
    out = F.lit(C.UNKNOWN_REGION)
    for region, states in C.CENSUS_REGIONS.items():
        out = F.when(state.isin(*states), F.lit(region)).otherwise(out)
    return out


def verdict(base: Column, augmented: Column, threshold: float = C.CHANGE_THRESHOLD) -> Column:
    change = F.try_divide(augmented - base, base)
    return (
        F.when(base.isNull() | augmented.isNull(), F.lit("unknown"))
        .when(change < -threshold, F.lit("improved"))
        .when(change > threshold, F.lit("degraded"))
        .otherwise(F.lit("no change"))
    )


def delta_text(base: Column, augmented: Column) -> Column:
    """Signed difference with an arrow for its direction; digits come from the double's exact value, ties to even."""
    change = augmented - base
    digits = F.replace(F.format_number(change, 4), F.lit(","), F.lit(""))
    signed = F.when(digits.startswith("-"), digits).otherwise(F.concat(F.lit("+"), digits))
    arrow = F.when(change < 0, F.lit("↓")).when(change > 0, F.lit("↑")).otherwise(F.lit("→"))
    return F.when(change.isNull(), F.lit("n/a")).otherwise(
        F.concat(signed, F.lit(" "), arrow)
    )


def correlation_label(rho: Column, p_value: Column) -> Column:
    size = F.abs(rho)
    strength = (
        F.when(size >= 0.6, F.lit("strong")).when(size >= 0.3, F.lit("moderate")).otherwise(F.lit("weak"))
    )
    sign = F.when(rho < 0, F.lit("negative")).otherwise(F.lit("positive"))
    significance = F.when(p_value < 0.05, F.lit("significant")).otherwise(F.lit("not significant"))
    text = F.concat(strength, F.lit(" "), sign, F.lit(" correlation ("), significance, F.lit(" at p<0.05)"))
    return F.when(rho.isNull(), F.lit("insufficient data")).otherwise(text)


def iso_utc(ts: Column) -> Column:
    """ISO text with the UTC offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
