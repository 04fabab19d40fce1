"""The given tables as the tables of the domain (Spark side; ``ctes.py`` says the same in SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid import constants as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their station number and hour."""
    return with_station(table(spark, sf_dir, "events"))


def with_station(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"),
        F.floor(F.col("user_id") / 30).alias("st"),
    )


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def by_type(mapping: dict[str, str], default: str | None) -> Column:
    out = F.lit(default)
    for kind, value in mapping.items():
        out = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(out)
    return out


PARAMETERS = {"click": "88101", "view": "42602", "purchase": "44201"}
POLLUTANTS = {"click": "pm25", "view": "no2", "purchase": "ozone"}
LIVE = {"click": "PM2.5", "view": "NO2", "purchase": "OZONE"}


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State name and region per nation key; 25 rows by definition of the table."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("bigint").alias("nk"), F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
    )


def nation_key() -> Column:
    return (F.col("st") % 2) + 5 * (F.col("st") % 5)


def raw_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw measurement row per event."""
    return raw_rows(events(spark, sf_dir), nations(spark, sf_dir))


def raw_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The same for any rows of events, a stream included."""
    rows = rows.withColumn("nk", nation_key())
    measured = (
        F.when(_every(211), F.lit(-5.0)).when(_every(307), F.lit(9999.0))
        .when(F.col("event_type") == "purchase", F.col("value") / 1000).otherwise(F.col("value"))
    )
    local = F.col("hour") - F.expr("interval 5 hours")
    return rows.join(F.broadcast(places), "nk").select(
        "event_id",
        (F.col("st") % 50 + 1).cast("string").alias("state_code"),
        (F.col("st") % 7 + 1).cast("string").alias("county_code"),
        F.col("st").cast("string").alias("site_number"),
        by_type(PARAMETERS, "99999").alias("parameter_code"),
        F.col("event_type").alias("parameter"),
        (F.col("event_id") % 2 + 1).cast("int").alias("poc"),
        (25 + F.col("st") % 25).cast("double").alias("latitude"),
        (-120 + F.col("st") % 50).cast("double").alias("longitude"),
        F.when(_every(997), F.lit("bad")).otherwise(F.date_format("hour", "yyyy-MM-dd")).alias("date_gmt"),
        F.date_format("hour", "HH:mm").alias("time_gmt"),
        F.date_format(local, "yyyy-MM-dd").alias("date_local"),
        F.date_format(local, "HH:mm").alias("time_local"),
        measured.alias("sample_measurement"),
        "state", F.concat(F.lit("county_"), (F.col("st") % 7).cast("string")).alias("county"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).select("state", "region")


def _station_of(st: Column) -> Column:
    from hourgrid.functions.scalar import station_id

    return station_id(st % 50 + 1, st % 7 + 1, st)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-form weather for every station and hour with an event; some rows and values are missing."""
    hours = events(spark, sf_dir).select("st", "hour").distinct()
    index = F.col("st") * 720 + F.floor(F.unix_seconds("hour") / 3600) % 720
    angle = F.lit(2.0) * F.lit(3.141592653589793) * F.hour("hour") / F.lit(24.0)
    return hours.withColumn("i", index).filter(F.col("i") % 181 != 0).select(
        _station_of(F.col("st")).alias("station_id"), F.col("hour").alias("timestamp_utc"),
        F.when(F.col("i") % 97 != 0, 15 + 10 * F.sin(angle)).alias("temperature_2m"),
        (2.0 + F.col("st") % 5 + F.cos(angle)).alias("wind_speed_10m"),
        (50.0 + F.col("i") % 40).alias("relative_humidity_2m"),
    )


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather payloads with parallel arrays, one per station and day (at most 24 entries)."""
    days = weather(spark, sf_dir).groupBy("station_id", F.to_date("timestamp_utc").alias("day")).agg(
        F.sort_array(F.collect_list(F.struct(
            "timestamp_utc", "temperature_2m", "wind_speed_10m", "relative_humidity_2m",
        ))).alias("h")
    )
    # Humidity is absent on every seventh day of the month.
    hourly = F.struct(
        F.transform("h", lambda x: F.date_format(x["timestamp_utc"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        F.col("h.temperature_2m").alias("temperature_2m"), F.col("h.wind_speed_10m").alias("wind_speed_10m"),
        F.when(F.dayofmonth("day") % 7 != 0, F.col("h.relative_humidity_2m")).alias("relative_humidity_2m"),
    )
    return days.select("station_id", "day", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provider payload per event: success, no header, no data, or an error."""
    rows = raw_long(spark, sf_dir)
    kind = F.col("event_id") % 10
    status = F.when(kind == 0, F.lit("No Data matched")).when(kind == 1, F.lit("Failed")).when(kind == 2, F.lit("Failed")).otherwise(F.lit("Success"))
    error = F.when(kind == 1, F.lit("quota exceeded")).when(kind == 2, F.lit("no matching data for request"))
    header = F.when(kind != 3, F.array(F.struct(status.alias("status"), error.alias("error"))))
    data = F.array(F.struct(
        "state_code", "county_code", "site_number", "parameter_code", "parameter", "date_local", "time_local",
        F.col("sample_measurement").cast("string").alias("sample_measurement"),
        F.col("state").alias("state_name"),
    ))
    return rows.select(
        F.col("event_id").alias("payload_id"),
        F.to_json(F.struct(header.alias("Header"), data.alias("Data"))).alias("payload"),
    )


def current_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One current-weather payload per event, with absent and unreadable parts."""
    temp = F.when(_every(11), F.lit("n/a")).when(~_every(7), F.col("value").cast("string"))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("request_id"),
        F.to_json(F.struct(
            F.struct(temp.alias("temp"), F.when(~_every(5), F.col("event_id") % 100).alias("humidity")).alias("main"),
            F.when(~_every(3), F.struct((F.col("value") / 8).alias("speed"))).alias("wind"),
            F.when(~_every(13), F.array(F.struct(F.col("event_type").alias("description")))).alias("weather"),
            F.when(~_every(17), F.concat(F.lit("city_"), F.col("st"))).alias("name"),
        )).alias("payload"),
    )


def forecast_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second provider: every fourth event has no answer, every ninth an unreadable one."""
    return events(spark, sf_dir).filter(~_every(4)).select(
        F.col("event_id").alias("request_id"),
        F.to_json(F.struct(F.struct(
            F.when(_every(9), F.lit("x")).otherwise((F.col("value") / 10).cast("string")).alias("temperature_2m"),
            F.lit(3.5).alias("wind_speed_10m"), (F.col("event_id") % 90).alias("relative_humidity_2m"),
        ).alias("current"))).alias("payload"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live observation records: the sites of a station lie a hundredth of a degree apart."""
    site = F.col("user_id") % 30
    shown = F.when(_every(211), F.lit(-5.0)).otherwise(F.col("value")).cast("string")
    return events(spark, sf_dir).select(
        ((25 + F.col("st") % 25) * 100 + site).cast("double").alias("_lat"),
        ((-120 + F.col("st") % 50) * 100 + site).cast("double").alias("_lon"),
        F.when(_every(997), F.lit("bad")).otherwise(F.date_format("hour", "yyyy-MM-dd'T'HH:mm")).alias("UTC"),
        by_type(LIVE, "CO").alias("Parameter"),
        F.when(~_every(3), F.when(F.col("event_type") == "click", F.lit("UG/M3")).otherwise(F.lit(" ppb "))).alias("Unit"),
        F.when(_every(401), F.lit("n/a")).otherwise(shown).alias("Value"),
        F.when(~_every(5), shown).alias("RawConcentration"),
        F.when(~_every(13), F.concat(F.lit("site_"), F.col("user_id").cast("string"))).alias("SiteName"),
        F.lpad(F.col("user_id").cast("string"), 9, "0").alias("FullAQSCode"),
    ).select((F.col("_lat") / 100).alias("Latitude"), (F.col("_lon") / 100).alias("Longitude"),
             "UTC", "Parameter", "Unit", "Value", "RawConcentration", "SiteName", "FullAQSCode")


def live_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One live request per station, day and pollutant, ending at the day's last hour with an event."""
    days = events(spark, sf_dir).groupBy("st", F.to_date("hour").alias("day")).agg(F.max("hour").alias("end_hour"))
    kinds = F.posexplode(F.array(*map(F.lit, C.POLLUTANTS))).alias("i", "pollutant")
    return days.select("st", "day", "end_hour", kinds).select(
        ((F.col("st") * 100 + F.dayofmonth("day")) * 3 + F.col("i")).cast("bigint").alias("request_id"),
        "pollutant", (25 + F.col("st") % 25).cast("double").alias("latitude"),
        (-120 + F.col("st") % 50).cast("double").alias("longitude"), "end_hour",
    )


def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scoring request per event, some of them invalid."""
    v, i = F.col("value"), F.col("event_id")
    return events(spark, sf_dir).select(
        i.alias("request_id"),
        by_type({**POLLUTANTS, "error": "so2"}, "pm25").alias("pollutant"),
        F.when(i % 4 == 1, F.lit("GradientBoosting")).when(i % 4 == 2, F.lit("RandomForest"))
        .when(i % 40 == 3, F.lit("Other")).alias("model"),
        F.struct((v - 20).alias("latitude"), (v * 2 - 100).alias("longitude")).alias("station"),
        F.struct(
            F.when(i % 17 != 0, v).alias("lag_1h"), F.when(i % 19 != 0, v * 0.5).alias("lag_24h"),
            F.when(i % 5 != 0, v * 0.25).alias("lag_168h"), F.when(i % 7 != 0, v * 0.75).alias("roll_24h_mean"),
            F.when(i % 7 != 0, v * 0.125).alias("roll_24h_std"), (v * 0.625).alias("roll_168h_mean"),
            (v * 0.0625).alias("roll_168h_std"),
            F.when(i % 23 == 0, F.lit(2)).otherwise((i % 2).cast("int")).alias("drift_flag"),
        ).alias("readings"),
        F.col("hour").alias("prediction_time"),
    )
