"""Recent observations near a request to a feature vector with provenance.

A live request is ``request_id, pollutant, latitude, longitude, end_hour``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import requests as R
from hourgrid.operators import timeblocks as B

CELL_LATITUDE = 2 * C.BOX_LATITUDE
CELL_LONGITUDE = 2 * C.BOX_LONGITUDE
BUCKET_HOURS = 24
UNAVAILABLE = "unavailable/backfilled"
ASSUMED = "derived/assumed"


# -- Observations --------------------------------------------------------------------------------

def readings(observations: DataFrame) -> DataFrame:
    """Typed observation rows. ``value`` is the raw concentration, else the reported value; text that is
    no number and negative values are null, rows with an unreadable time are dropped."""
    number = F.coalesce("RawConcentration", "Value").try_cast("double")
    value = S.not_nan(F.when(number >= 0, number))
    return observations.select(
        F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"),
        F.try_to_timestamp("UTC", F.lit("yyyy-MM-dd'T'HH:mm")).alias("timestamp_utc"),
        F.col("Parameter").alias("parameter"), value.alias("value"),
        F.upper(F.trim(F.when(F.col("Unit") != "", F.col("Unit")))).alias("unit"),
        F.when(F.col("SiteName") != "", F.col("SiteName")).alias("site_name"),
        F.col("FullAQSCode").alias("site_code"),
    ).filter(F.col("timestamp_utc").isNotNull())


def normalise_units(rows: DataFrame) -> DataFrame:
    """Row-level variant of the unit rule: ozone in PPB (or without a unit) becomes PPM."""
    unit = F.coalesce("unit", F.lit("PPB"))
    ozone = F.col("parameter") == C.LIVE_PARAMETERS["ozone"]
    return rows.withColumns({
        "value": F.when(ozone & (unit == "PPB"), F.col("value") / 1000).otherwise(F.col("value")),
        "unit_warning": ozone & ~unit.isin("PPB", "PPM"),
    })


def site_hours(rows: DataFrame) -> DataFrame:
    """Sums per place, site, parameter and hour, so that the range join sees no repeated readings."""
    labelled = F.when(F.col("unit").isNotNull(), F.struct("site_code", "unit"))
    return rows.groupBy("latitude", "longitude", "site_name", "parameter", "timestamp_utc").agg(
        F.count(F.lit(1)).alias("n_raw"), F.sum("value").alias("value_sum"),
        F.count("value").alias("value_count"), F.min(labelled).alias("labelled"),
    )


def _cell(column: Column, size: float) -> Column:
    return F.floor(column / size)


def place_days(requests: DataFrame, history_hours: int = C.HISTORY_HOURS) -> DataFrame:
    """One row per different place and day that some request asks for, with the hours asked for on that day."""
    end = B.hour_index(F.col("end_hour"))
    asked = requests.select("latitude", "longitude", (end - history_hours).alias("_from"), end.alias("_to")).distinct()
    day = F.explode(F.sequence(_cell(F.col("_from"), BUCKET_HOURS), _cell(F.col("_to"), BUCKET_HOURS)))
    return asked.withColumn("_day", day).groupBy("latitude", "longitude", "_day").agg(
        F.greatest(F.min("_from"), F.first("_day") * BUCKET_HOURS).alias("_low"),
        F.least(F.max("_to"), F.first("_day") * BUCKET_HOURS + BUCKET_HOURS - 1).alias("_high"),
    )


def place_hours(days: DataFrame, sites: DataFrame) -> DataFrame:
    """Per place and hour an entry for each parameter: sums over the sites inside the place's box.

    A range join in three dimensions as an equi-join on grid cells and day buckets with the exact limits
    checked afterwards. Its rows follow the places, however many requests ask for one; the day in the key
    spreads a crowded cell over many tasks.
    """
    def buckets(low: Column, high: Column, size: float) -> Column:
        return F.explode(F.sequence(_cell(low, size), _cell(high, size)))

    boxes = days.select(
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), "_day", "_low", "_high",
        *(column.alias(f"_{name}") for name, column in R.bounding_box(F.col("latitude"), F.col("longitude")).items()),
    )
    boxes = boxes.withColumn("_cy", buckets(F.col("_min_lat"), F.col("_max_lat"), CELL_LATITUDE)).withColumn(
        "_cx", buckets(F.col("_min_lon"), F.col("_max_lon"), CELL_LONGITUDE))
    placed = sites.withColumns({
        "_hour": B.hour_index(F.col("timestamp_utc")),
        "_cy": _cell(F.col("latitude"), CELL_LATITUDE), "_cx": _cell(F.col("longitude"), CELL_LONGITUDE),
    }).withColumn("_day", _cell(F.col("_hour"), BUCKET_HOURS))
    matched = boxes.join(placed, ["_cy", "_cx", "_day"]).filter(
        F.col("_hour").between(F.col("_low"), F.col("_high"))
        & F.col("latitude").between(F.col("_min_lat"), F.col("_max_lat"))
        & F.col("longitude").between(F.col("_min_lon"), F.col("_max_lon"))
    )
    labelled = F.when(F.col("labelled").isNotNull(), F.struct(
        F.col("_hour").alias("hour"), F.col("labelled.site_code").alias("code"), F.col("labelled.unit").alias("unit"),
    ))
    sums = matched.groupBy("_lat", "_lon", "_day", "_hour", "parameter").agg(
        F.sum("n_raw").alias("n_raw"), F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count"),
        F.min(labelled).alias("labelled"), F.collect_set("site_name").alias("sites"),
    )
    # Parameters are a handful, so an hour's entries are a short list.
    entry = F.struct("parameter", "n_raw", "value_sum", "value_count", "labelled", "sites")
    return sums.groupBy("_lat", "_lon", "_day", "_hour").agg(F.collect_list(entry).alias("entries"))


def nearby(requests: DataFrame, sites: DataFrame, history_hours: int = C.HISTORY_HOURS) -> DataFrame:
    """Per request and hour of its window the entries of its place: ``request_id, pollutant, _hour, entries``."""
    end = B.hour_index(F.col("end_hour"))
    index = place_hours(place_days(requests, history_hours), sites)
    asked = requests.select(
        "request_id", "pollutant", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        (end - history_hours).alias("_from"), end.alias("_to"),
    ).withColumn("_day", F.explode(F.sequence(_cell(F.col("_from"), BUCKET_HOURS), _cell(F.col("_to"), BUCKET_HOURS))))
    return asked.join(index, ["_lat", "_lon", "_day"]).filter(F.col("_hour").between(F.col("_from"), F.col("_to"))).select(
        "request_id", "pollutant", "_hour", "entries")


QUESTION = ("pollutant", "latitude", "longitude", "end_hour")


def questions(requests: DataFrame) -> DataFrame:
    """The different questions among requests, as requests whose id is the question itself.

    What lies near a place does not depend on who asks, so it is worked out once for each question.
    """
    return requests.select(*QUESTION).distinct().withColumn("request_id", F.struct(*QUESTION))


def answered(requests: DataFrame, answers: DataFrame, how: str = "left") -> DataFrame:
    """Requests next to the answers to their questions."""
    return requests.withColumn("_question", F.struct(*QUESTION)).join(
        answers.withColumnRenamed("request_id", "_question"), "_question", how).drop("_question")


def _parameter_of(pollutant: Column) -> Column:
    return S.choose(pollutant, C.LIVE_PARAMETERS)


def request_hours(matched: DataFrame) -> DataFrame:
    """Per request and hour: the area sum of the asked pollutant and what the report needs."""
    mine = F.filter("entries", lambda e: e["parameter"] == _parameter_of(F.col("pollutant")))
    rows = matched.withColumn("_mine", F.get(mine, F.lit(0)))
    return rows.select(
        "request_id", "pollutant", "_hour",
        F.aggregate("entries", F.lit(0).cast("long"), lambda n, e: n + e["n_raw"]).alias("n_raw"),
        F.coalesce("_mine.n_raw", F.lit(0).cast("long")).alias("n_mine"), F.col("_mine.value_sum").alias("_sum"),
        F.coalesce("_mine.value_count", F.lit(0).cast("long")).alias("_count"), F.col("_mine.labelled").alias("_labelled"),
        F.coalesce("_mine.sites", F.array().cast("array<string>")).alias("_sites"),
        F.transform("entries", lambda e: e["parameter"]).alias("_parameters"),
    )


def hourly_area_mean(matched: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean over nearby sites per request and hour, in training units.

    Ozone is divided by 1000 where the first labelled record of the request says PPB or none has a
    label; any other unit is taken as it is. At most ``history + 1`` rows per request.
    """
    per_request = Window.partitionBy("request_id")
    unit = F.coalesce(F.min("_labelled").over(per_request)["unit"], F.lit("PPB"))
    scale = F.when((F.col("pollutant") == "ozone") & (unit == "PPB"), F.lit(1000.0)).otherwise(F.lit(1.0))
    mean = F.try_divide(F.col("_sum"), F.col("_count")) / scale
    mean = S.round_even(mean, digits) if digits is not None else mean
    return request_hours(matched).withColumns({
        "value": mean, "unit": unit,
        "unit_warning": (F.col("pollutant") == "ozone") & ~unit.isin("PPB", "PPM"),
    })


def request_grid(requests: DataFrame, hours: DataFrame, history_hours: int = C.HISTORY_HOURS) -> DataFrame:
    """The fixed hourly grid of every request, missing hours null."""
    end = B.hour_index(F.col("end_hour"))
    grid = requests.select("request_id", "pollutant", F.explode(F.sequence(end - history_hours, end)).alias("_hour"))
    return grid.join(hours.select("request_id", "_hour", "value"), ["request_id", "_hour"], "left").select(
        "request_id", "pollutant", B.hour_start(F.col("_hour")).alias("timestamp_utc"), "value"
    )


def live_coverage(requests: DataFrame, hours: DataFrame, history_hours: int = C.HISTORY_HOURS) -> DataFrame:
    """Per request: raw records, hours with and without a value, site names, parameters seen and warnings."""
    found = hours.groupBy("request_id").agg(*_coverage_aggregates())
    joined = requests.join(found, "request_id", "left")
    return joined.select(
        "request_id", "pollutant", *_coverage_columns(history_hours),
        F.array_compact(F.array(*_coverage_warnings(history_hours))).alias("warnings"),
    )


def _coverage_aggregates() -> list[Column]:
    return [
        F.sum("n_raw").alias("_raw"), F.sum("n_mine").alias("_mine"), F.count("value").alias("_covered"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sites")))).alias("_sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_parameters")))).alias("_seen"),
    ]


def _coverage_columns(history_hours: int, named: bool = True) -> list[Column]:
    covered = F.coalesce("_covered", F.lit(0))
    any_mine = F.coalesce("_mine", F.lit(0)) > 0
    none = F.array().cast("array<string>")
    return [
        F.coalesce("_raw", F.lit(0)).alias("n_raw_obs"), covered.alias("coverage_hours"),
        # Without any record of the pollutant no grid is laid out at all.
        F.when(any_mine, F.lit(history_hours + 1) - covered).otherwise(F.lit(0)).alias("missing_hours"),
        *((F.coalesce("_sources", none).alias("sources"),) if named else ()), F.coalesce("_seen", none).alias("parameters_seen"),
    ]


# -- Warnings: array<struct<code, feature, count>>, worded by whoever shows them -------------------

NO_RECORDS, OTHER_PARAMETERS, HOURS_MISSING = "no_records", "other_parameters_only", "hours_missing"
LAG_MISSING, ODD_UNIT, FEW_VALUES, DRIFT_ASSUMED, NO_WEATHER = "lag_missing", "odd_unit", "few_values", "drift_assumed", "no_weather"


def _warning(when: Column, code: str, feature: str | None = None, count: Column | None = None) -> Column:
    return F.when(when, F.struct(
        F.lit(code).alias("code"), F.lit(feature).cast("string").alias("feature"),
        (F.lit(None) if count is None else count).cast("long").alias("count"),
    ))


def _coverage_warnings(history_hours: int) -> list[Column]:
    raw, mine = F.coalesce("_raw", F.lit(0)), F.coalesce("_mine", F.lit(0))
    missing = F.lit(history_hours + 1) - F.coalesce("_covered", F.lit(0))
    return [
        _warning(raw == 0, NO_RECORDS, count=raw), _warning((raw > 0) & (mine == 0), OTHER_PARAMETERS, count=raw),
        _warning((mine > 0) & (missing > 0), HOURS_MISSING, count=missing),
    ]


def _feature_warnings() -> list[Column]:
    found = F.col("latest_hour").isNotNull()
    return [
        *(_warning(found & F.col(f"lag_{k}h").isNull(), LAG_MISSING, f"lag_{k}h") for k in (1, 24, 168)),
        _warning(F.coalesce("_unit_warning", F.lit(False)), ODD_UNIT),
        _warning(found & F.col("roll_168h_mean").isNull(), FEW_VALUES, "roll_168h_mean", F.col("_week_count")),
        _warning(found, DRIFT_ASSUMED, "drift_flag"),
        _warning(found & F.col("weather_error").isNotNull(), NO_WEATHER),
    ]


# -- Features ------------------------------------------------------------------------------------

def latest_observation(hours: DataFrame) -> DataFrame:
    """Most recent hour with a value per request."""
    return hours.groupBy("request_id").agg(
        B.hour_start(F.max(F.when(F.col("value").isNotNull(), F.col("_hour")))).alias("latest_hour")
    )


def range_stats(column: str, hours: int, hour: Column, reference: Column, digits: int | None = 4) -> tuple[Column, Column]:
    """Aggregates: mean and population deviation over ``[reference - hours, reference)``, from two values on."""
    value = F.when((hour >= reference - hours) & (hour < reference), F.col(column))
    enough = F.count(value) >= 2
    mean, deviation = F.avg(value), F.stddev_pop(value)
    if digits is not None:
        mean, deviation = S.round_even(mean, digits), S.round_even(deviation, digits)
    return F.when(enough, mean), F.when(enough, deviation)


def rolling_range_stats(df: DataFrame, column: str, hours: int, digits: int | None = 4) -> DataFrame:
    """Row-wise variant over time rather than rows: ``[t - hours, t)``, from two values on.

    Runs on time blocks like all series windows, with a halo of ``hours``.
    """
    seconds = Window.partitionBy(B.KEY, "_block").orderBy("_hour").rangeBetween(-hours, -1)
    enough = F.count(column).over(seconds) >= 2
    mean, deviation = F.avg(column).over(seconds), F.stddev_pop(column).over(seconds)
    if digits is not None:
        mean, deviation = S.round_even(mean, digits), S.round_even(deviation, digits)
    return B.own(B.spread(df, hours).select(
        "*", F.when(enough, mean).alias(f"mean_{hours}h"), F.when(enough, deviation).alias(f"std_{hours}h"),
    ))


def point_lags(hours: DataFrame, offsets: tuple[int, ...] = (1, 24, 168)) -> DataFrame:
    """Value exactly some hours before the latest observation of each request; null if there is none."""
    latest = Window.partitionBy("request_id")
    t0 = F.max(F.when(F.col("value").isNotNull(), F.col("_hour"))).over(latest)
    rows = hours.withColumn("_t0", t0)
    return rows.groupBy("request_id").agg(*(
        F.max(F.when(F.col("_hour") == F.col("_t0") - k, F.col("value"))).alias(f"lag_{k}h") for k in offsets
    ))


def question_answers(
    requests: DataFrame, observations: DataFrame, history_hours: int = C.HISTORY_HOURS, digits: int | None = 4,
) -> DataFrame:
    """One row per different question: what its hours say, and the names of the sites behind it in ``_sources``."""
    hours = hourly_area_mean(nearby(questions(requests), site_hours(readings(observations)), history_hours), digits)
    per_request = Window.partitionBy("request_id")
    t0 = F.max(F.when(F.col("value").isNotNull(), F.col("_hour"))).over(per_request)
    rows = hours.withColumn("_t0", t0)
    day_mean, day_std = range_stats("value", 24, F.col("_hour"), F.col("_t0"), digits)
    week_mean, week_std = range_stats("value", 168, F.col("_hour"), F.col("_t0"), digits)
    in_week = (F.col("_hour") >= F.col("_t0") - 168) & (F.col("_hour") < F.col("_t0"))
    return rows.groupBy("request_id").agg(
        *_coverage_aggregates(), F.max("_t0").alias("_t0"),
        *(F.max(F.when(F.col("_hour") == F.col("_t0") - k, F.col("value"))).alias(f"lag_{k}h") for k in (1, 24, 168)),
        day_mean.alias("roll_24h_mean"), day_std.alias("roll_24h_std"),
        week_mean.alias("roll_168h_mean"), week_std.alias("roll_168h_std"),
        F.count(F.when(in_week, F.col("value"))).alias("_week_count"),
        F.max(F.col("unit_warning")).alias("_unit_warning"),
    )


def question_sources(answers: DataFrame) -> DataFrame:
    """The names of the sites behind each question of ``question_answers``."""
    return answers.select(F.col("request_id").alias("question"), F.col("_sources").alias("_names"))


def named_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Live features that hold their question, with the names of the sites behind it instead."""
    none = F.array().cast("array<string>")
    return rows.join(sources, "question", "left").withColumn("sources", F.coalesce("_names", none)).drop("_names", "question")


def live_features(
    requests: DataFrame, observations: DataFrame, weather: DataFrame | None = None,
    history_hours: int = C.HISTORY_HOURS, digits: int | None = 4,
) -> DataFrame:
    """One row per request: status, latest hour, the features, their provenance and warnings.

    ``weather`` is the result of ``weather_fallback`` for the same requests. ``status`` is ``ok``,
    ``no observations`` or ``missing essential lags``.
    """
    return answered_features(requests, question_answers(requests, observations, history_hours, digits), weather, history_hours)


def answered_features(
    requests: DataFrame, answers: DataFrame, weather: DataFrame | None = None, history_hours: int = C.HISTORY_HOURS, named: bool = True,
) -> DataFrame:
    """``live_features`` from the answers to the requests' questions.

    Many requests share a question, and its sites may be thousands. Where rows are stored, take them with their
    ``question`` (``named=False``) and put names in their place (``named_sources``) when they are read.
    """
    if weather is not None:
        weather_columns = ("request_id", *C.WEATHER_COLUMNS, "weather_source", "weather_error")
        joined = requests.join(weather.select(*weather_columns), "request_id", "left")
    else:
        joined = requests.withColumns({
            **{c: F.lit(None).cast("double") for c in C.WEATHER_COLUMNS},
            "weather_source": F.lit("none"), "weather_error": F.lit("no weather given"),
        })
    # Answers come last: rows that hold the names of sites are not shuffled.
    joined = answered(joined, answers if named else answers.drop("_sources"))
    # A request the weather table does not know has failed weather, too.
    joined = joined.withColumns({
        "weather_source": F.coalesce("weather_source", F.lit("all weather sources failed")),
        "weather_error": F.when(F.col("weather_source").isNull(), F.lit("no weather given")).otherwise(F.col("weather_error")),
        "latest_hour": B.hour_start(F.col("_t0")),
    })
    latest = F.col("latest_hour")
    status = (
        F.when(latest.isNull(), F.lit("no observations"))
        .when(F.col("lag_1h").isNull() | F.col("lag_24h").isNull(), F.lit("missing essential lags"))
        .otherwise(F.lit("ok"))
    )
    calendar = {k: F.when(latest.isNotNull(), v.cast("double")) for k, v in S.calendar_features(latest).items()}
    complete = joined.withColumns({**calendar, "drift_flag": F.lit(0.0), "status": status})
    return complete.select(
        "request_id", "pollutant", "status", "latest_hour", R.target_time(latest).alias("target_time"),
        *(F.col(c).cast("double").alias(c) for c in C.FEATURES),
        R.feature_map().alias("features_used"), provenance().alias("feature_provenance"),
        F.array_compact(F.array(*_coverage_warnings(history_hours), *_feature_warnings())).alias("warnings"),
        *_coverage_columns(history_hours, named), "weather_source", "weather_error",
        *(() if named else (F.struct(*QUESTION).alias("question"),)),
    )


def provenance() -> Column:
    """Source label of every feature."""
    labels: dict[str, Column] = {}
    for name in C.FEATURES:
        missing = F.col(name).isNull()
        if name.startswith("lag_"):
            labels[name] = F.when(missing, F.lit(UNAVAILABLE)).otherwise(F.lit("live"))
        elif name.startswith("roll_"):
            labels[name] = F.when(missing, F.lit(UNAVAILABLE)).otherwise(F.lit("derived"))
        elif name in ("latitude", "longitude"):
            labels[name] = F.lit("input")
        elif name == "drift_flag":
            labels[name] = F.lit(ASSUMED)
        elif name in C.WEATHER_COLUMNS:
            labels[name] = F.when(F.col("weather_error").isNotNull(), F.lit(UNAVAILABLE)).otherwise(F.lit("live"))
        else:
            labels[name] = F.lit("derived")
    return F.create_map(*(part for k, v in labels.items() for part in (F.lit(k), v)))


PROVENANCE_LABELS = ("live", "derived", UNAVAILABLE, ASSUMED)


def provenance_counts(df: DataFrame, column: str = "feature_provenance") -> DataFrame:
    """Features per label; the total also holds the label ``input``, which has no count of its own."""
    def count_of(label: str) -> Column:
        return F.size(F.filter(F.map_values(column), lambda v: v == label)).cast("long")

    names = {"live": "live", "derived": "derived", UNAVAILABLE: "unavailable", ASSUMED: "assumed"}
    return df.select(
        "request_id", *(count_of(label).alias(name) for label, name in names.items()),
        F.size(F.map_values(column)).cast("long").alias("total"),
    )
