"""Lag, rolling, calendar and weather features with a target some hours ahead."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import cleaning, quality
from hourgrid.operators import timeblocks as B

QUARTER, DAY, WEEK = 6, 24, 168


def lags(df: DataFrame, column: str, hours: Sequence[int] = (1, DAY, WEEK)) -> DataFrame:
    """Values some rows back on a complete hourly grid."""
    rows = B.spread(df, max(map(abs, hours), default=0))
    return B.own(rows.select(
        "*", *(F.lag(column, k).over(B.by_hour()).alias(f"lag_{k}h") for k in hours)
    ))


def target_lead(df: DataFrame, column: str, horizon: int = C.HORIZON_HOURS) -> DataFrame:
    rows = B.spread(df, abs(horizon))
    return B.own(rows.select("*", F.lead(column, horizon).over(B.by_hour()).alias("target")))


def rolling_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean and sample deviation of the past day and week, the current row excluded."""
    rows = _rolling(B.spread(df), [column])
    return B.own(rows.selectExpr(
        *df.columns, "_block", "_hour", *(f"{e} as {name}" for name, e in _rolled(column).items())
    ))


def _rolling(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Merged statistics of the past day (``_day_*``) and week (``_week_*``) of each column.

    A day is the union of the past quarter seen from four rows, a week that of the past day seen from seven, so that
    each row aggregates 6 rows, not 24 and 168.
    """
    rows = rows.selectExpr("*", *(f"{cleaning.chunk_statistics(c, -QUARTER, -1)} as _q0_{c}" for c in columns))
    rows = rows.selectExpr("*", *(
        f"lag(_q0_{c}, {QUARTER * k}) {B.OVER} as _q{k}_{c}" for c in columns for k in range(1, DAY // QUARTER)
    ))
    rows = cleaning.merge_statistics(rows, {f"_day_{c}": [f"_q{k}_{c}" for k in range(DAY // QUARTER)] for c in columns})
    rows = rows.selectExpr("*", *(
        f"named_struct('n', _day_{c}_n, 'mean', _day_{c}_mean, 'm2', coalesce(_day_{c}_var * (_day_{c}_n - 1), 0d)) as _d0_{c}"
        for c in columns
    ))
    rows = rows.selectExpr("*", *(
        f"lag(_d0_{c}, {DAY * k}) {B.OVER} as _d{k}_{c}" for c in columns for k in range(1, WEEK // DAY)
    ))
    return cleaning.merge_statistics(rows, {f"_week_{c}": [f"_d{k}_{c}" for k in range(WEEK // DAY)] for c in columns})


def _rolled(column: str) -> dict[str, str]:
    """Expressions of the rolling features; half a window of readings is required."""
    out = {}
    for label, side, width in (("24h", "_day", DAY), ("168h", "_week", WEEK)):
        merged = f"{side}_{column}"
        out[f"roll_{label}_mean"] = f"if({merged}_n >= {width // 2}, {merged}_mean, null)"
        out[f"roll_{label}_std"] = f"if({merged}_n >= {width // 2}, sqrt({merged}_var), null)"
    return out


def impute_lag168(df: DataFrame) -> DataFrame:
    return df.withColumn("lag_168h", F.coalesce("lag_168h", "roll_168h_mean"))


def fill_both_ways(df: DataFrame, column: str, by: Sequence[str] = ("station_id",)) -> DataFrame:
    """Forward fill, then backward fill what is left at the start.

    A series is read in blocks: the nearest reading outside a block comes from a table with one row per
    series and block.
    """
    hour = B.hour_index(F.col("timestamp_utc"))
    rows = df.withColumn("_hour", hour).withColumn("_block", B.block_of(F.col("_hour")))
    reading = F.when(F.col(column).isNotNull(), F.col("_hour"))
    edges = rows.groupBy(*by, "_block").agg(
        F.min_by(column, reading).alias("_first"), F.max_by(column, reading).alias("_last"),
    )
    forwards = Window.partitionBy(*by).orderBy("_block")
    edges = edges.select(
        *by, "_block",
        F.last("_last", ignorenulls=True).over(
            forwards.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", ignorenulls=True).over(
            Window.partitionBy(*by).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
        ).alias("_after"),
    )
    ordered = Window.partitionBy(*by, "_block").orderBy("_hour")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first_here = Window.partitionBy(*by, "_block")
    filled = F.coalesce(
        F.last(column, ignorenulls=True).over(so_far), F.col("_before"),
        F.min_by(column, reading).over(first_here), F.col("_after"),
    )
    return rows.join(edges, [*by, "_block"], "left").withColumn(column, filled).drop(
        "_hour", "_block", "_before", "_after"
    )


def eligible_stations(
    clean: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS, min_readings: int = C.MIN_READINGS,
) -> DataFrame:
    """Stations and pollutants with enough readings."""
    counts = clean.groupBy("station_id").agg(*(F.count(p).alias(p) for p in pollutants))
    return counts.select(
        "station_id", quality.per_pollutant({p: {"readings": F.col(p)} for p in pollutants})
    ).filter(F.col("readings") >= min_readings)


def _eligibility(clean: DataFrame, pollutants: Sequence[str], min_readings: int) -> DataFrame:
    """A marker row per station and block that says which pollutants have enough readings.

    Markers have no hour, so they come first in their block and hold nothing that a window could see.
    """
    hour = B.hour_index(F.col("timestamp_utc"))
    blocks = clean.groupBy("station_id", B.block_of(hour).alias("_block")).agg(
        *(F.count(p).alias(p) for p in pollutants))
    stations = blocks.groupBy("station_id").agg(
        F.collect_list("_block").alias("_blocks"), *(F.sum(p).alias(p) for p in pollutants))
    enough = ", ".join(f"'{p}', {p} >= {min_readings}" for p in pollutants)
    return stations.selectExpr("station_id", f"named_struct({enough}) as _eligible", "explode(_blocks) as _block")


FEATURE_TABLE = ("pollutant", "station_id", "timestamp_utc", *C.FEATURES, "target")


def feature_rows(
    clean: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS, min_readings: int = C.MIN_READINGS,
    horizon: int = C.HORIZON_HOURS,
) -> DataFrame:
    """All features for every hour of every eligible series, one row per pollutant; nothing dropped yet."""
    if not 0 < horizon <= B.HALO_HOURS:
        raise ValueError(f"horizon must be between 1 and {B.HALO_HOURS} hours")
    present = [c for c in C.WEATHER_COLUMNS if c in clean.columns]
    rows = B.spread(clean.select(
        "station_id", "timestamp_utc", "latitude", "longitude", *present, *pollutants,
        *(f"{p}_drift_flag" for p in pollutants),
    )).unionByName(_eligibility(clean, pollutants, min_readings), allowMissingColumns=True)
    rows = rows.selectExpr("* except (_eligible)", "max(_eligible) over (partition by station_id, _block) as _eligible")
    rows = rows.selectExpr("*", *(
        f"{move}({p}, {k}) {B.OVER} as {name}_{p}"
        for p in pollutants
        for move, k, name in (
            ("lag", 1, "_lag1"), ("lag", DAY, "_lag24"), ("lag", WEEK, "_lag168"), ("lead", horizon, "_target"),
        )
    ))
    own_rows = _rolling(rows, pollutants).filter(f"_block = floor(_hour / {B.BLOCK_HOURS})")
    structs = []
    for p in pollutants:
        rolled = _rolled(p)
        fields = {
            "pollutant": f"'{p}'", "lag_1h": f"_lag1_{p}", "lag_24h": f"_lag24_{p}",
            "lag_168h": f"coalesce(_lag168_{p}, {rolled['roll_168h_mean']})", **rolled,
            "drift_flag": f"cast({p}_drift_flag as int)", "target": f"_target_{p}",
        }
        row = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        structs.append(f"if(_eligible.{p}, {row}, null)")
    long = own_rows.selectExpr(
        "station_id", "timestamp_utc", "latitude", "longitude", *present,
        f"inline(array_compact(array({', '.join(structs)})))",
    )
    absent = {c: F.lit(None).cast("double") for c in C.WEATHER_COLUMNS if c not in present}
    return long.withColumns({**S.calendar_features(F.col("timestamp_utc")), **absent}).select(*FEATURE_TABLE)


def required_columns(weather: bool) -> list[str]:
    return ["target", *(C.FEATURES if weather else C.BASE_FEATURES)]


def drop_incomplete(rows: DataFrame, weather: bool = True) -> DataFrame:
    return rows.dropna(subset=required_columns(weather))


def build_features(
    clean: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS, min_readings: int = C.MIN_READINGS,
    weather: str = "auto", horizon: int = C.HORIZON_HOURS,
) -> DataFrame:
    """Feature table, one row per pollutant, station and hour, incomplete rows dropped.

    ``weather='auto'`` requires weather values where the columns exist and passes nulls where they do
    not; ``'required'`` and ``'optional'`` force one or the other.
    """
    need = {"required": True, "optional": False}.get(
        weather, all(c in clean.columns for c in C.WEATHER_COLUMNS)
    )
    return drop_incomplete(feature_rows(clean, pollutants, min_readings, horizon), need)


def _complete(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def drop_counts(rows: DataFrame) -> DataFrame:
    """Rows dropped per pollutant, and how many of them only lack weather."""
    base, full = _complete(required_columns(False)), _complete(required_columns(True))
    return rows.groupBy("pollutant").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(full).alias("kept"),
        F.count_if(~full).alias("dropped"), F.count_if(base & ~full).alias("dropped_weather_only"),
    )


def feature_audit(
    clean: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS, min_readings: int = C.MIN_READINGS,
) -> DataFrame:
    """Usable rows, used and skipped stations and weather-only drops per pollutant."""
    rows = feature_rows(clean, pollutants, min_readings)
    base, full = _complete(required_columns(False)), _complete(required_columns(True))
    used = rows.groupBy("pollutant", "station_id").agg(
        F.count_if(full).alias("usable"), F.count_if(base & ~full).alias("weather_dropped"),
    ).groupBy("pollutant").agg(
        F.sum("usable").alias("usable_rows"), F.count_if(F.col("usable") > 0).alias("stations_used"),
        F.sum("weather_dropped").alias("weather_null_dropped"),
    )
    skipped = clean.groupBy("station_id").agg(*(F.count(p).alias(p) for p in pollutants)).select(
        quality.per_pollutant({p: {"readings": F.col(p)} for p in pollutants})
    ).groupBy("pollutant").agg(F.count_if(F.col("readings") < min_readings).alias("stations_skipped"))
    zero = F.lit(0)
    return skipped.join(used, "pollutant", "left").select(
        "pollutant",
        *(F.coalesce(F.col(c), zero).alias(c) for c in ("usable_rows", "stations_used")),
        "stations_skipped",
        F.coalesce(F.col("weather_null_dropped"), zero).alias("weather_null_dropped"),
    )
