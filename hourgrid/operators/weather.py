"""Weather payloads, the weather join and its diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid import schemas
from hourgrid.functions import scalar as S


def explode_hourly_payload(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per hour from parallel arrays; an absent array gives nulls, no times give no rows."""
    parsed = S.with_json(payloads, "_p", payload, schemas.WEATHER_PAYLOAD).withColumn("_p", F.col("_p.hourly"))
    zipped = F.arrays_zip(*(
        F.coalesce(F.col(f"_p.{name}"), F.array().cast(f"array<{'string' if name == 'time' else 'double'}>")).alias(name)
        for name in ("time", *C.WEATHER_COLUMNS)
    ))
    hours = parsed.select("station_id", F.inline(F.slice(zipped, F.lit(1), F.size(F.coalesce(F.col("_p.time"), F.array().cast("array<string>"))))))
    return hours.select(
        "station_id", F.try_to_timestamp("time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("timestamp_utc"),
        *(S.not_nan(F.col(c)).alias(c) for c in C.WEATHER_COLUMNS),
    )


CURRENT_FIELDS = ("temp_c", "wind_speed_ms", "humidity_pct", "conditions", "station_name", "error")


def flatten_current(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested current-weather payload to flat columns; an unreadable number sets ``error`` instead."""
    main, wind, sky = F.col("_p.main"), F.col("_p.wind"), F.col("_p.weather")
    numbers = {"temp": main["temp"], "speed": wind["speed"], "humidity": main["humidity"]}
    broken = [
        F.when(text.isNotNull() & text.try_cast("double").isNull(), F.lit(name))
        for name, text in numbers.items()
    ] + [
        F.when(F.col("_p").isNull(), F.lit("payload")),
        F.when(F.size(sky) == 0, F.lit("weather")),
    ]
    first_broken = F.coalesce(*broken)
    values = {
        "temp_c": S.round_even(numbers["temp"].try_cast("double"), 1),
        "wind_speed_ms": S.round_even(F.coalesce(numbers["speed"].try_cast("double"), F.lit(0.0)), 1),
        "humidity_pct": numbers["humidity"].try_cast("double").try_cast("long"),
        "conditions": F.coalesce(F.get(sky, F.lit(0))["description"], F.lit("unknown")),
        "station_name": F.coalesce(F.col("_p.name"), F.lit("unknown")),
    }
    parsed = S.with_json(payloads, "_p", payload, schemas.CURRENT_WEATHER_PAYLOAD)
    return parsed.select(
        *payloads.columns,
        *(F.when(first_broken.isNull(), v).alias(k) for k, v in values.items()),
        F.when(first_broken.isNotNull(), F.concat(F.lit("Parse error: "), first_broken)).alias("error"),
    )


def flatten_current_forecast(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The second provider's shape: ``{"current": {...}}`` with the model's own column names."""
    current = F.col("_p.current")
    broken = F.coalesce(*(
        F.when(current[c].isNotNull() & current[c].try_cast("double").isNull(), F.lit(c))
        for c in C.WEATHER_COLUMNS
    ), F.when(F.col("_p").isNull(), F.lit("payload")))
    fine = broken.isNull()
    names = dict(zip(("temp_c", "wind_speed_ms", "humidity_pct"), C.WEATHER_COLUMNS))
    parsed = S.with_json(payloads, "_p", payload, schemas.CURRENT_WEATHER_PAYLOAD_B)
    return parsed.select(
        *payloads.columns,
        *(F.when(fine, current[c].try_cast("double")).alias(k) for k, c in names.items()),
        F.when(fine, F.lit("current")).alias("conditions"),
        F.when(fine, F.lit("grid point")).alias("station_name"),
        F.when(~fine, F.concat(F.lit("Parse error: "), broken)).alias("error"),
    )


def deduplicate(weather: DataFrame) -> DataFrame:
    """One row per station and hour, the smallest, so that the join cannot multiply rows.

    Rows are dealt by station and hour first: the one sort that finds the smallest row is the sort the join needs.
    """
    keys = ("station_id", "timestamp_utc")
    ordered = Window.partitionBy(*keys).orderBy(*C.WEATHER_COLUMNS)
    return weather.select(*keys, *C.WEATHER_COLUMNS).repartition(*keys).withColumn(
        "_row", F.row_number().over(ordered)).filter("_row = 1").drop("_row")


def join_weather(clean: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join on station and hour; the weather's shuffle and sort serve the join as well."""
    return clean.join(deduplicate(weather), ["station_id", "timestamp_utc"], "left")


def coverage(joined: DataFrame) -> DataFrame:
    per_station = joined.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("hours"), F.count("temperature_2m").alias("with_weather"),
    )
    total, matched = F.coalesce(F.sum("hours"), F.lit(0)), F.coalesce(F.sum("with_weather"), F.lit(0))
    return per_station.agg(
        total.alias("total_rows"), matched.alias("rows_with_weather"),
        F.coalesce(F.round(F.try_divide(matched, total) * 100, 2), F.lit(0.0)).alias("coverage_pct"),
        F.count_if(F.col("with_weather") > 0).alias("stations_with_weather"),
        F.count_if(F.col("with_weather") == 0).alias("stations_without_weather"),
    )


def null_rates(df: DataFrame) -> DataFrame:
    """Percentage of nulls per weather column (one decimal) and of rows with any null."""
    any_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in C.WEATHER_COLUMNS))
    rates = [
        F.round(F.avg(F.col(c).isNull().cast("double")) * 100, 1).alias(f"{c}_null_pct")
        for c in C.WEATHER_COLUMNS
    ]
    return df.agg(*rates, F.round(F.avg(any_null.cast("double")) * 100, 2).alias("any_null_pct"))


def _whole(prefix: str) -> Column:
    return F.struct(*(F.col(f"{prefix}.{c}").alias(c) for c in ("temp_c", "wind_speed_ms", "humidity_pct")))


def weather_fallback(
    requests: DataFrame, first: DataFrame, second: DataFrame,
    first_name: str = "provider A", second_name: str = "provider B",
) -> DataFrame:
    """Weather of the first provider without an error, else of the second, else the error text.

    ``first`` and ``second`` hold at most one flattened row per ``request_id``. A source is taken as a
    whole: columns of the two are never mixed.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("request_id", F.struct(
            F.lit(True).alias("present"), "temp_c", "wind_speed_ms",
            F.col("humidity_pct").cast("double").alias("humidity_pct"), "error",
        ).alias(name))

    joined = (
        requests.join(side(first, "_a"), "request_id", "left").join(side(second, "_b"), "request_id", "left")
    )
    a_fine = F.col("_a.present").isNotNull() & F.col("_a.error").isNull()
    b_fine = F.col("_b.present").isNotNull() & F.col("_b.error").isNull()
    chosen = F.when(a_fine, _whole("_a")).when(b_fine, _whole("_b"))
    failure = F.concat(
        F.lit("all weather sources failed: "), F.coalesce(F.col("_b.error"), F.lit("no answer"))
    )
    out = joined.withColumn("_w", chosen)
    return out.select(
        *requests.columns,
        F.col("_w.temp_c").alias("temperature_2m"), F.col("_w.wind_speed_ms").alias("wind_speed_10m"),
        F.col("_w.humidity_pct").alias("relative_humidity_2m"),
        F.when(a_fine, F.lit(first_name)).when(b_fine, F.lit(second_name))
        .otherwise(F.lit("all weather sources failed")).alias("weather_source"),
        F.when(~a_fine & ~b_fine, failure).alias("weather_error"),
    )
