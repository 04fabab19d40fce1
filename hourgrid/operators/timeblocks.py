"""Time blocks: windows over long hourly series without long window partitions.

A station's series is cut into blocks of ``BLOCK_HOURS``. Every window in this package is partitioned
by ``(station_id, _block)``; rows close to an edge are copied into the neighbouring block (the halo of
``HALO_HOURS`` on either side), so that any frame up to the halo's width sees exactly the rows it would see in
the whole series. After the windows, each row is kept only in the block that owns it. One station may
therefore hold any share of the data: its blocks are spread over many tasks.

The only reach that no halo bounds is "the next reading after a gap". ``block_table`` supplies it from
one row per station and block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HALO_HOURS = 168
BLOCK_HOURS = 16 * HALO_HOURS
KEY = "station_id"
TIME = "timestamp_utc"


def hour_index(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600)


def hour_start(hour: Column, offset: Column | int = 0) -> Column:
    """The grid's time in an hour; ``offset`` is the station's place within the hour, in seconds."""
    return F.timestamp_seconds(hour * 3600 + offset)


def hour_offset(ts: Column) -> Column:
    return F.pmod(F.unix_seconds(ts), F.lit(3600))


def block_of(hour: Column) -> Column:
    return F.floor(hour / BLOCK_HOURS)


def spread(df: DataFrame, reach: int = HALO_HOURS) -> DataFrame:
    """Add ``_hour`` and one row per block whose halo covers it (one block for most rows).

    ``reach`` is the widest frame asked for, in hours; the halo is never narrower than ``HALO_HOURS``.
    """
    halo = max(HALO_HOURS, reach)
    hour = F.col("_hour")
    first = F.floor((hour - halo) / BLOCK_HOURS)
    last = F.floor((hour + halo) / BLOCK_HOURS)
    return df.withColumn("_hour", hour_index(F.col(TIME))).withColumn(
        "_block", F.explode(F.sequence(first, last))
    )


def own(df: DataFrame) -> DataFrame:
    """Keep each row in its own block only and drop the helper columns."""
    return df.filter(F.col("_block") == block_of(F.col("_hour"))).drop("_block", "_hour")


def by_hour() -> WindowSpec:
    return Window.partitionBy(KEY, "_block").orderBy("_hour")


OVER = f"over (partition by {KEY}, _block order by _hour)"


def frame(start: int, end: int) -> str:
    """Row frame inside a block; negative numbers lie before the current row."""
    def edge(k: int) -> str:
        return "current row" if k == 0 else f"{abs(k)} {'preceding' if k < 0 else 'following'}"

    return f"over (partition by {KEY}, _block order by _hour rows between {edge(start)} and {edge(end)})"


def block_table(df: DataFrame, columns: Sequence[str], reach: int = HALO_HOURS) -> DataFrame:
    """One row per station and block of the station's range, with what a block cannot see by itself.

    The grid of a station steps by an hour from its first reading; ``_offset`` is that reading's place within
    the hour, in seconds, and readings at another place are not on the grid.
    Result: ``station_id, _block``, the first and last hour of the grid (``_first``, ``_last``), ``_offset``, and
    for each column ``<column>_after`` = struct(hour, value), its first reading beyond the block's halo for
    frames of ``reach`` hours.
    Rows are reduced to one per station, block and offset before the windows, which run over those only.
    """
    hour = hour_index(F.col(TIME))
    # A row serves the blocks up to the last one whose halo ends before it.
    serves = F.floor((hour - max(HALO_HOURS, reach)) / BLOCK_HOURS) - 1
    seen = df.select(
        KEY, serves.alias("_serves"), hour_offset(F.col(TIME)).alias("_at"), hour.alias("_hour"),
        F.unix_seconds(TIME).alias("_seconds"), *columns,
    )
    whole = f"over (partition by {KEY})"
    firsts = seen.groupBy(KEY, "_serves", "_at").agg(
        F.min("_seconds").alias("_min"), F.max("_seconds").alias("_max"),
        *(F.expr(f"min(_hour) filter (where {c} is not null)").alias(f"{c}_h") for c in columns),
        *(F.expr(f"min_by({c}, _hour) filter (where {c} is not null)").alias(f"{c}_v") for c in columns),
    ).selectExpr(
        "*", f"min(_min) {whole} as _start", f"max(_max) {whole} as _end",
    ).selectExpr("*", "pmod(_start, 3600) as _offset").filter("_at = _offset").selectExpr(
        "*", "floor(_start / 3600) as _first", "floor((_end - _offset) / 3600) as _last",
    )
    back = f"over (partition by {KEY} order by _serves desc)"
    running = f"over (partition by {KEY} order by _serves desc rows between unbounded preceding and current row)"
    spans = firsts.selectExpr(
        KEY, "_serves", "_offset", "_first", "_last",
        f"lead(_serves) {back} + 1 as _from", f"lag(_serves) {back} is null as _newest",
        *(
            f"last(case when {c}_h is not null then named_struct('hour', {c}_h, 'value', {c}_v) end, true)"
            f" {running} as {c}_after" for c in columns
        ),
    )
    # Blocks without rows of their own take the reading of the next block that has one; blocks after the
    # newest row's have nothing to take.
    first_block, last_block = f"floor(_first / {BLOCK_HOURS})", f"floor(_last / {BLOCK_HOURS})"
    low = f"greatest(coalesce(_from, {first_block}), {first_block})"
    high = f"if(_newest, {last_block}, _serves)"
    return spans.selectExpr(
        KEY, "_first", "_last", "_offset", "_serves", *(f"{c}_after" for c in columns),
        f"explode(if({low} <= {high}, sequence({low}, {high}), array())) as _block",
    ).selectExpr(
        KEY, "_block", "_first", "_last", "_offset",
        *(f"case when _block <= _serves then {c}_after end as {c}_after" for c in columns),
    )
