"""Ingest planning: windows, pull plan, resume filters, chunk accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S


def year_windows(ranges: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Split each inclusive date range at the ends of calendar years; an empty range gives no rows."""
    first, last = F.col(start), F.col(end)
    years = ranges.filter(first <= last).withColumn(
        "year", F.explode(F.sequence(F.year(first), F.year(last)))
    )
    return years.withColumns({
        "window_start": F.greatest(first, F.make_date("year", F.lit(1), F.lit(1))),
        "window_end": F.least(last, F.make_date("year", F.lit(12), F.lit(31))),
    })


def pull_plan(counties: DataFrame, parameters: Sequence[str] = tuple(C.PARAMETER_CODES)) -> DataFrame:
    """Every parameter for every county and year window, numbered in that order, with its chunk key.

    ``counties`` has ``state_code, county_code, start_date, end_date``. The product is an expansion of
    each county's row. Numbers come from counts per state, so that no task orders the whole plan.
    """
    windows = year_windows(counties)
    inside = Window.partitionBy("state_code").orderBy("county_code", "window_start")
    numbered = windows.withColumn("_in_state", F.row_number().over(inside))
    # At most some sixty states: the only unpartitioned window sees one row per state.
    sizes = windows.groupBy("state_code").agg(F.count(F.lit(1)).alias("_size"))
    running = Window.orderBy("state_code").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "state_code", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.orderBy(F.lit(1)).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    plan = numbered.join(offsets, "state_code").select(
        "*", F.posexplode(F.array(*map(F.lit, parameters))).alias("_p", "parameter_code")
    )
    return plan.select(
        (F.col("_p") * F.col("_all") + F.col("_before") + F.col("_in_state")).alias("position"),
        "parameter_code", "state_code", "county_code", "window_start", "window_end",
        chunk_key(F.col("year")).alias("chunk_key"),
    )


def chunk_key(year):
    """``{parameter}_{state}_{county}_{year}``."""
    return F.concat_ws("_", "parameter_code", "state_code", "county_code", year.cast("string"))


def resume_filter(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Plan entries whose chunk does not exist yet."""
    return plan.join(existing.select("chunk_key"), "chunk_key", "left_anti")


def complete_chunks(weather: DataFrame, expected: int = C.ROWS_PER_STATION_YEAR) -> DataFrame:
    """Stations whose stored rows are complete."""
    return weather.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= expected)


def still_to_fetch(stations: DataFrame, weather: DataFrame, expected: int = C.ROWS_PER_STATION_YEAR) -> DataFrame:
    return stations.join(complete_chunks(weather, expected), "station_id", "left_anti")


def row_count_check(weather: DataFrame, expected: int = C.ROWS_PER_STATION_YEAR) -> DataFrame:
    """Stations whose number of weather rows differs from the expected one."""
    counts = weather.groupBy("station_id").agg(F.count(F.lit(1)).alias("rows"))
    return counts.filter(F.col("rows") != expected).withColumn("expected", F.lit(expected).cast("long"))


def chunk_row_counts(rows: DataFrame, key: str = "chunk_key") -> DataFrame:
    """Rows per chunk with the share of all; the total is summed over chunks, not rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total_rows")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")


def pull_summary(rows: DataFrame, target: int = C.PULL_TARGET_ROWS) -> DataFrame:
    """Rows and local time coverage in total, per parameter and per state, in one pass.

    Result: ``section`` (total, parameter, state), ``name``, ``rows``, ``first_local``, ``last_local`` and
    ``below_target`` (set on the total).
    """
    grouped = rows.select("parameter", "state_name", "datetime_local").groupBy("parameter", "state_name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("datetime_local").alias("_a"), F.max("datetime_local").alias("_z"),
    )
    p, s = F.col("parameter"), F.col("state_name")
    sets = grouped.groupingSets([[], [p], [s]], p, s).agg(
        F.grouping("parameter").alias("_np"), F.grouping("state_name").alias("_ns"),
        F.sum("_n").alias("rows"), F.min("_a").alias("first_local"), F.max("_z").alias("last_local"),
    )
    is_p, is_s = F.col("_np") == 0, F.col("_ns") == 0
    return sets.select(
        F.when(is_p, F.lit("parameter")).when(is_s, F.lit("state")).otherwise(F.lit("total")).alias("section"),
        F.when(is_p, p).when(is_s, s).otherwise(F.lit("all")).alias("name"),
        F.coalesce("rows", F.lit(0)).alias("rows"), "first_local", "last_local",
        (~is_p & ~is_s & (F.coalesce("rows", F.lit(0)) < target)).alias("below_target"),
    )


def list_states(raw: DataFrame) -> DataFrame:
    return raw.select("state_code", "state").distinct().orderBy("state_code", "state")


def list_counties(raw: DataFrame, state_code: str | None = None) -> DataFrame:
    rows = raw.select("state_code", "county_code", "county")
    if state_code is not None:
        rows = rows.filter(F.col("state_code") == state_code)
    return rows.distinct().orderBy("state_code", "county_code", "county")


def normalize_pull(rows: DataFrame) -> DataFrame:
    """Local timestamp and numeric casts of the columns present; unreadable values become null."""
    out = {}
    if {"date_local", "time_local"} <= set(rows.columns):
        out["datetime_local"] = S.parse_hour(F.col("date_local"), F.col("time_local")).cast("timestamp_ntz")
    for name in ("sample_measurement", "mdl", "uncertainty", "latitude", "longitude"):
        if name in rows.columns:
            out[name] = F.col(name).cast("string").try_cast("double")
    return rows.withColumns(out)
