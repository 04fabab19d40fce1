"""Raw long measurements to a clean hourly table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import timeblocks as B

METADATA = ("latitude", "longitude", "state", "county")


# -- Raw rows ------------------------------------------------------------------------------------

def with_station_id(raw: DataFrame) -> DataFrame:
    return raw.withColumn(
        "station_id", S.station_id(F.col("state_code"), F.col("county_code"), F.col("site_number"))
    )


def with_timestamp(raw: DataFrame) -> DataFrame:
    return raw.withColumn("timestamp_utc", S.parse_hour(F.col("date_gmt"), F.col("time_gmt")))


def parse_utc(raw: DataFrame) -> DataFrame:
    """Rows whose GMT date and time can be read, with ``timestamp_utc``."""
    return with_timestamp(raw).filter(F.col("timestamp_utc").isNotNull())


def keep_parameters(raw: DataFrame) -> DataFrame:
    """Rows of the target parameters, with ``pollutant``.

    The trimmed comparison cannot be pushed to a file scan; the implied ``contains`` tests can.
    """
    code = F.col("parameter_code").cast("string")
    pushed = reduce(lambda a, b: a | b, (code.contains(c) for c in C.PARAMETER_CODES))
    return raw.filter(pushed & F.trim(code).isin(*C.PARAMETER_CODES)).withColumn(
        "pollutant", S.choose(F.trim(code), C.PARAMETER_CODES)
    )


def measurements(raw: DataFrame) -> DataFrame:
    """Typed target rows: station, hour, pollutant, sensor, value and the metadata present."""
    rows = with_station_id(keep_parameters(parse_utc(raw)))
    poc = F.col("poc").cast("int") if "poc" in raw.columns else F.lit(1)
    value = S.not_nan(F.col("sample_measurement").cast("double"))
    meta = [name for name in METADATA if name in raw.columns]
    return rows.select(
        "station_id", "timestamp_utc", "pollutant", poc.alias("poc"), value.alias("value"), *meta
    )


# -- Aggregation to hours ------------------------------------------------------------------------

def station_metadata(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First non-null value of each metadata column per station, in (hour, sensor) order.

    Rows shrink to the few different metadata of each station first, by a numeric position that aggregates
    in hash tables; only those rows are ordered by values.
    """
    columns = [c for c in METADATA if c in rows.columns] if columns is None else list(columns)
    few = rows.groupBy("station_id", *columns).agg(F.min(_position(rows)).alias("_position"))
    firsts = [
        F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.struct("_position", name))).alias(name)
        for name in columns
    ]
    return few.groupBy("station_id").agg(*firsts)


def _position(rows: DataFrame) -> Column:
    """One number in the order of (hour, sensor), missing ones first."""
    hour = F.unix_micros("timestamp_utc") if "timestamp_utc" in rows.columns else F.lit(0)
    sensor = F.col("poc").cast("long") if "poc" in rows.columns else F.lit(0)
    before = F.lit(-(1 << 62))  # before every hour
    scaled = F.coalesce(hour, before).cast("decimal(19,0)") * F.lit(1 << 40).cast("decimal(14,0)")
    return (scaled + F.coalesce(sensor, F.lit(-(1 << 39))).cast("decimal(19,0)")).cast("decimal(38,0)")


def sensor_mean(rows: DataFrame) -> DataFrame:
    """Mean over parallel sensors per station, hour and pollutant."""
    return rows.groupBy("station_id", "timestamp_utc", "pollutant").agg(F.avg("value").alias("value"))


def pivot_hours(rows: DataFrame) -> DataFrame:
    """Sensor mean and pivot in one aggregation; hours without any value vanish."""
    means = [
        F.avg(F.when(F.col("pollutant") == p, F.col("value"))).alias(p) for p in C.POLLUTANTS
    ]
    any_value = reduce(lambda a, b: a | b, (F.col(p).isNotNull() for p in C.POLLUTANTS))
    return rows.groupBy("station_id", "timestamp_utc").agg(*means).filter(any_value)


def station_range(wide: DataFrame) -> DataFrame:
    return wide.groupBy("station_id").agg(
        F.min("timestamp_utc").alias("first_hour"), F.max("timestamp_utc").alias("last_hour")
    )


# -- Complete grid -------------------------------------------------------------------------------

def hourly_grid(ranges: DataFrame) -> DataFrame:
    """Every hour from first to last per station, in steps from the first reading, whatever its minute.

    Ranges are first cut into blocks, which are spread over the cluster before they are expanded.
    """
    offset = B.hour_offset(F.col("first_hour"))
    first = B.hour_index(F.col("first_hour"))
    last = F.floor((F.unix_seconds("last_hour") - offset) / 3600)
    blocks = ranges.select(
        "station_id", first.alias("_first"), last.alias("_last"), offset.alias("_offset"),
        F.explode(F.sequence(B.block_of(first), B.block_of(last))).alias("_block"),
    ).repartition("station_id", "_block")
    start = F.greatest(F.col("_first"), F.col("_block") * B.BLOCK_HOURS)
    end = F.least(F.col("_last"), (F.col("_block") + 1) * B.BLOCK_HOURS - 1)
    hours = blocks.select("station_id", "_offset", F.explode(F.sequence(start, end)).alias("_hour"))
    return hours.select("station_id", B.hour_start(F.col("_hour"), F.col("_offset")).alias("timestamp_utc"))


def grid_join(grid: DataFrame, wide: DataFrame) -> DataFrame:
    return grid.join(wide, ["station_id", "timestamp_utc"], "left")


def attach_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per station on the right side; adaptive execution broadcasts it while it is small."""
    return df.join(metadata, "station_id", "left")


def dense_blocks(wide: DataFrame, metadata: DataFrame) -> DataFrame:
    """The complete hourly grid with values and metadata, one shuffle on ``(station_id, _block)``.

    Only observed hours and one marker per block are shuffled. Inside its block each row then emits
    the hours up to the next row, which yields the same rows as joining a prepared grid. Readings off the
    station's grid, at another minute than its first reading, are left out there.
    Result: ``station_id, _block, _hour``, the values, and ``_info`` of the block.
    """
    meta = [c for c in METADATA if c in metadata.columns]
    start = f"greatest(_first, _block * {B.BLOCK_HOURS} - {B.HALO_HOURS})"
    end = f"least(_last, (_block + 1) * {B.BLOCK_HOURS} + {B.HALO_HOURS} - 1)"
    info = ", ".join(["'end'", end, "'offset'", "_offset", *(f"'{c}', {c}" for c in (*(f"{p}_after" for p in C.POLLUTANTS), *meta))])
    markers = B.block_table(wide, C.POLLUTANTS).join(metadata, "station_id", "left").selectExpr(
        "station_id", "_block", f"{start} as _hour", "0 as _rank", "_offset as _at",
        *(f"cast(null as double) as {p}" for p in C.POLLUTANTS), f"named_struct({info}) as _info",
    )
    observed = B.spread(wide).withColumn("_at", B.hour_offset(F.col("timestamp_utc"))).selectExpr(
        "station_id", "_block", "_hour", "1 as _rank", "_at", *C.POLLUTANTS, "null as _info"
    )
    order = "over (partition by station_id, _block order by _hour, _rank {})"
    running = order.format("rows between unbounded preceding and current row")
    rows = observed.unionByName(markers).selectExpr(
        "station_id", "_block", "_hour", "_rank", "_at", *C.POLLUTANTS, f"first(_info, true) {running} as _info",
    ).filter("_at = _info.offset").selectExpr(
        "station_id", "_block", "_hour", *C.POLLUTANTS, "_info", f"lead(_hour) {order.format('')} as _next",
    )
    # A halo copy in a block outside the station's range has no marker and is not needed; a marker on an
    # observed hour emits nothing.
    return rows.selectExpr(
        "station_id", "_block", "_hour as _at", *C.POLLUTANTS, "_info",
        "coalesce(_next, _info.end + 1) as _next",
    ).filter("_info is not null and _next > _at").selectExpr(
        "station_id", "_block", "_at", *C.POLLUTANTS, "_info",
        "explode(sequence(_at, _next - 1)) as _hour",
    ).selectExpr(
        "station_id", "_block", "_hour", "_info", *(f"if(_hour = _at, {p}, null) as {p}" for p in C.POLLUTANTS)
    )


# -- Gap filling ---------------------------------------------------------------------------------

def _fill(df: DataFrame, columns: Sequence[str], after: str, limit: int, strict: bool) -> DataFrame:
    """Filled values and flags on rows that are complete within ``(station_id, _block)``.

    ``after`` is the pattern of the expression for the first reading beyond the block.
    """
    kept = [c for c in df.columns if c not in columns]
    rows = df.selectExpr(
        "*", *(f"if({c} is null, null, named_struct('hour', _hour, 'value', {c})) as _r_{c}" for c in columns)
    ).selectExpr(
        *kept, *columns,
        *(f"lag(_r_{c}, 1) ignore nulls {B.OVER} as _p_{c}" for c in columns),
        *(f"coalesce(lead(_r_{c}, 1) ignore nulls {B.OVER}, {after.format(c)}) as _n_{c}" for c in columns),
    )
    line = "(_n_{0}.value - _p_{0}.value) / (_n_{0}.hour - _p_{0}.hour) * (_hour - _p_{0}.hour) + _p_{0}.value"
    if strict:
        guess = f"if(_n_{{0}}.hour - _p_{{0}}.hour - 1 <= {limit}, {line}, null)"
    else:
        guess = f"if(_n_{{0}} is null, _p_{{0}}.value, {line})"
    filled = f"coalesce({{0}}, if(_hour - _p_{{0}}.hour <= {limit}, {guess}, null)) as _f_{{0}}"
    rows = rows.selectExpr(*kept, *columns, *(filled.format(c) for c in columns))
    return rows.selectExpr(
        *kept, *(f"_f_{c} as {c}" for c in columns),
        *(f"{c} is null and _f_{c} is not null as {c}_interp_flag" for c in columns),
    )


def interpolate_gaps(
    df: DataFrame, columns: Sequence[str] = C.POLLUTANTS, limit: int = C.GAP_LIMIT_HOURS, strict: bool = False,
) -> DataFrame:
    """Linear interpolation on a complete hourly grid, with ``<column>_interp_flag``.

    The first ``limit`` hours of every gap are filled, along the line to the reading after the gap; a
    trailing gap holds the last value; leading gaps stay. With ``strict`` only gaps of at most ``limit``
    hours between two readings are filled.
    """
    after = B.block_table(df, columns, limit + 1).drop("_first", "_last", "_offset")
    rows = B.spread(df, limit + 1).join(after, ["station_id", "_block"], "left")
    filled = _fill(rows, columns, "{0}_after", limit, strict)
    return B.own(filled.drop(*(f"{c}_after" for c in columns)))


# -- Outliers and drift --------------------------------------------------------------------------

def flag_negative(df: DataFrame, columns: Sequence[str] = C.POLLUTANTS) -> DataFrame:
    return df.selectExpr("*", *(f"coalesce({c} < 0, false) as {c}_neg_flag" for c in columns))


def flag_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]] = C.BOUNDS) -> DataFrame:
    """Flag values outside the inclusive bounds and null them."""
    kept = [c for c in df.columns if c not in bounds]
    inside = {c: f"{c} between {low} and {high}" for c, (low, high) in bounds.items()}
    return df.selectExpr(
        *kept, *(f"if({test}, {c}, null) as {c}" for c, test in inside.items()),
        *(f"coalesce(not ({test}), false) as {c}_bounds_flag" for c, test in inside.items()),
    )


def chunk_statistics(column: str, start: int, end: int) -> str:
    """Count, mean and squared deviations over a short row frame, to be merged into a wider one."""
    over = B.frame(start, end)
    return (
        f"named_struct('n', count({column}) {over}, 'mean', avg({column}) {over}, "
        f"'m2', var_pop({column}) {over} * count({column}) {over})"
    )


def merge_statistics(df: DataFrame, chunks: dict[str, Sequence[str]]) -> DataFrame:
    """Add ``<label>_n, <label>_mean, <label>_var`` of the union of disjoint chunks.

    Means are merged first and deviations taken around the merged mean, so nothing cancels.
    """
    counted = df.selectExpr(
        "*",
        *(" + ".join(f"coalesce({c}.n, 0)" for c in parts) + f" as {label}_n" for label, parts in chunks.items()),
        *(" + ".join(f"coalesce({c}.n * {c}.mean, 0d)" for c in parts) + f" as {label}_sum" for label, parts in chunks.items()),
    )
    centred = counted.selectExpr("*", *(f"try_divide({label}_sum, {label}_n) as {label}_mean" for label in chunks))
    deviations = "coalesce({0}.m2 + {0}.n * ({0}.mean - {1}_mean) * ({0}.mean - {1}_mean), 0d)"
    return centred.selectExpr("*", *(
        f"try_divide({' + '.join(deviations.format(c, label) for c in parts)}, {label}_n - 1) as {label}_var"
        for label, parts in chunks.items()
    ))


# Share of a block's squared deviations that rounding may leave in a difference of running sums.
RESOLUTION = 1e-14


def _drift(df: DataFrame, columns: Sequence[str], z: float, min_n: int, width: int) -> DataFrame:
    """Drift flags on rows that are complete within ``(station_id, _block)``.

    The frame around a row is the difference of two running sums of deviations from the block's mean, so
    its width costs nothing. A variance below what rounding can leave behind counts as none, as it does
    for a constant series.
    """
    kept, behind, ahead = df.columns, width // 2, width // 2 - 1
    whole = f"over (partition by {B.KEY}, _block)"
    running = f"over (partition by {B.KEY}, _block order by _hour rows between unbounded preceding and current row)"
    sums = "named_struct('n', count(_d_{0}) {1}, 's', coalesce(sum(_d_{0}) {1}, 0d), 'q', coalesce(sum(_d_{0} * _d_{0}) {1}, 0d))"
    rows = df.selectExpr("*", *(f"{c} - avg({c}) {whole} as _d_{c}" for c in columns)).selectExpr(
        "*", *(f"{sums.format(c, running)} as _run_{c}" for c in columns),
        *(f"{sums.format(c, whole)} as _all_{c}" for c in columns),
    ).selectExpr(
        *kept, *(f"_d_{c}" for c in columns), *(f"_all_{c}" for c in columns),
        *(f"coalesce(lead(_run_{c}, {ahead}) {B.OVER}, _all_{c}) as _hi_{c}" for c in columns),
        *(
            f"coalesce(lag(_run_{c}, {behind + 1}) {B.OVER}, named_struct('n', 0L, 's', 0d, 'q', 0d)) as _lo_{c}"
            for c in columns
        ),
    ).selectExpr(
        *kept, *(f"_d_{c}" for c in columns), *(f"_all_{c}.q as _q_{c}" for c in columns),
        *(f"_hi_{c}.{k} - _lo_{c}.{k} as _{k}w_{c}" for c in columns for k in "nsq"),
    ).selectExpr(
        "*", *(f"try_divide(_sw_{c}, _nw_{c}) as _m_{c}" for c in columns),
        *(f"try_divide(_qw_{c} - try_divide(_sw_{c} * _sw_{c}, _nw_{c}), _nw_{c} - 1) as _v_{c}" for c in columns),
    )
    drifted = (
        "coalesce(_nw_{0} >= {1} and _v_{0} > {3} * _q_{0} / greatest(_nw_{0} - 1, 1)"
        " and abs(_d_{0} - _m_{0}) > {2} * sqrt(greatest(_v_{0}, 0d)), false) as {0}_drift_flag"
    )
    return rows.selectExpr(*kept, *(drifted.format(c, min_n, z, RESOLUTION) for c in columns))


def flag_drift(
    df: DataFrame, columns: Sequence[str] = C.POLLUTANTS, z: float = C.DRIFT_Z,
    min_n: int = C.DRIFT_MIN_READINGS, width: int = C.DRIFT_WINDOW_HOURS,
) -> DataFrame:
    """Flag values more than ``z`` sample deviations from the mean of the centred ``width`` rows.

    The frame is ``width / 2`` rows before to ``width / 2 - 1`` rows after; the grid must be complete.
    """
    if width % 2 or width // 2 > B.HALO_HOURS:
        raise ValueError(f"width must be even and at most {2 * B.HALO_HOURS}")
    return B.own(_drift(B.spread(df), columns, z, min_n, width))


# -- The whole step ------------------------------------------------------------------------------

CLEAN_COLUMNS = (
    "station_id", "timestamp_utc", *C.POLLUTANTS, *METADATA,
    *(f"{p}_{flag}_flag" for p in C.POLLUTANTS for flag in ("interp", "neg", "bounds", "drift")),
)


def normalize(raw: DataFrame) -> DataFrame:
    """Wide hourly table on the complete grid of each station, with metadata."""
    rows = measurements(raw)
    dense = dense_blocks(pivot_hours(rows), station_metadata(rows))
    meta = [c for c in METADATA if c in raw.columns]
    return B.own(dense.select(
        "station_id", B.hour_start(F.col("_hour"), F.col("_info.offset")).alias("timestamp_utc"), *C.POLLUTANTS,
        *(F.col(f"_info.{c}").alias(c) for c in meta), "_block", "_hour",
    ))


def clean_hourly(
    raw: DataFrame, limit: int = C.GAP_LIMIT_HOURS, strict: bool = False,
    bounds: dict[str, tuple[float, float]] = C.BOUNDS, z: float = C.DRIFT_Z, min_n: int = C.DRIFT_MIN_READINGS,
) -> DataFrame:
    """Normalise, fill gaps, flag outliers and drift: one shuffle by hour, one by block.

    All windows run on the partitioning that ``dense_blocks`` has made, halo included, so ``limit`` must lie
    within the halo; ``interpolate_gaps`` takes any.
    """
    if limit >= B.HALO_HOURS:
        raise ValueError(f"limit must be under {B.HALO_HOURS} hours")
    rows = measurements(raw)
    dense = dense_blocks(pivot_hours(rows), station_metadata(rows))
    filled = _fill(dense, C.POLLUTANTS, "_info.{0}_after", limit, strict)
    bounded = flag_bounds(flag_negative(filled), bounds)
    flagged = _drift(bounded, C.POLLUTANTS, z, min_n, C.DRIFT_WINDOW_HOURS)
    meta = [c for c in METADATA if c in raw.columns]
    return B.own(flagged.select(
        "station_id", B.hour_start(F.col("_hour"), F.col("_info.offset")).alias("timestamp_utc"), *C.POLLUTANTS,
        *(F.col(f"_info.{c}").alias(c) for c in meta),
        *(f"{p}_{flag}_flag" for p in C.POLLUTANTS for flag in ("interp", "neg", "bounds", "drift")),
        "_block", "_hour",
    ))
