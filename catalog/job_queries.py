"""Models, scoring and streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import adapter as A
from catalog.cleaning_queries import clean
from catalog.ctes import READINGS, fields, text_time
from catalog.feature_queries import joined, stored_features
from catalog.ingest_queries import OK, live_weather
from catalog.registry import register
from catalog.snap import sql as snap
from hourgrid import constants as C
from hourgrid.operators import cleaning, evaluate, features, live, weather
from hourgrid.plans import arima, scoring, store, training
from hourgrid.plans.staging import staged
from hourgrid.session import scratch_dir
from hourgrid.streaming import jobs

# The library's learners in full, over the partitions of the feature table.
FULL = training.TrainSettings()
BOOSTED, FOREST = ("GradientBoosting",), ("RandomForest",)
_LOADED: dict = {}


def store_root(spark):
    """Models live beside the other shared files of the cluster."""
    return scratch_dir(spark, "x").rpartition("/")[0] + "/models"


def trained(spark, sf, learners=BOOSTED, table=None):
    """Published models and their metrics; what no version holds for these tables yet is fitted and published.

    ``table`` is the stored feature table where the caller has it already.
    """
    models, metrics = {}, []
    source = store.fingerprint(A.raw_long(spark, sf))
    for name in learners:
        key = (spark.sparkContext.applicationId, sf, name)
        if key not in _LOADED:
            found = store.published(spark, store_root(spark), (name,), source)
            if found is None:
                table = table or stored_features(spark, sf)
                fitted, measured = training.train_and_evaluate(table, (name,), FULL)
                store.publish(fitted, staged(measured, "metrics"), store_root(spark), source, FULL)
                # The driver holds a model once: the fitted one goes before the published one is loaded.
                del fitted, measured
                found = store.published(spark, store_root(spark), (name,), source)
            _LOADED[key] = found
        models |= _LOADED[key][0]
        metrics.append(_LOADED[key][1])
    return models, reduce(DataFrame.unionByName, metrics)


@register("train_gbt")
def _(spark, sf):
    return trained(spark, sf)[1]


@register("train_rf")
def _(spark, sf):
    return trained(spark, sf, FOREST)[1]


def arima_forecasts(spark, sf):
    return staged(arima.station_forecasts(*series_tables(spark, sf)), "forecasts")


@register("station_arima")
def _(spark, sf):
    return arima.arima_metrics(arima_forecasts(spark, sf))


def series_tables(spark, sf):
    """Clean hours, from which features are built for the cutoffs as well; of the features no more is needed."""
    hours = staged(clean(spark, sf), "clean")
    table = features.build_features(staged(weather.join_weather(hours, A.weather(spark, sf)), "joined"))
    return hours, staged(evaluate.split_cutoffs(table), "cutoffs")


# A long regression's products of differences, as means over a series' full rows; d0 is the response.
LAGGED = range(arima.LONG_LAGS + 1)
PAIRS = [(i, j) for i in LAGGED for j in LAGGED if i <= j]
DEPTH = arima.LONG_LAGS + max(arima.ORDER[0], arima.ORDER[2])
SPANS = " UNION ALL ".join(f"""SELECT station_id, '{p}' AS pollutant, c.timestamp_utc, c.{p} AS value, k.cutoff
    FROM clean c JOIN cut k ON k.pollutant = '{p}'""" for p in C.POLLUTANTS)
_WHOLE = "PARTITION BY station_id, pollutant ORDER BY timestamp_utc"
DIFFERENCES = f"""SELECT *, value - lag(value) OVER ({_WHOLE}) AS d0 FROM (SELECT station_id, pollutant, timestamp_utc, coalesce(
      last_value(value IGNORE NULLS) OVER ({_WHOLE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER ({_WHOLE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
    FROM ({SPANS}) WHERE timestamp_utc < cutoff)"""


@register("arima_normal_equations", f"""SELECT station_id, pollutant, count(*) AS n, TRUE AS solved,
    {', '.join(f"{snap(f'avg(d{i} * d{j})')} AS p{i}_{j}" for i, j in PAIRS)}
    FROM (SELECT station_id, pollutant, d0, {', '.join(f'lag(d0, {k}) OVER ({_WHOLE}) AS d{k}' for k in (*LAGGED[1:], DEPTH))}
      FROM ({DIFFERENCES})) WHERE d{DEPTH} IS NOT NULL GROUP BY station_id, pollutant""")
def _(spark, sf):
    """Summed products of every series, and whether its coefficients satisfy the normal equations made of them."""
    found = arima.long_regression(arima.training_rows(*series_tables(spark, sf)))
    at = {pair: F.col("sums")[k] / F.col("rows") for k, pair in enumerate(PAIRS)}
    def product(i, j):
        return at[min(i, j), max(i, j)]
    left = [product(0, i) - reduce(lambda x, y: x + y, (F.col("a")[j - 1] * product(i, j) for j in LAGGED[1:])) for i in LAGGED[1:]]
    scale = 1e-6 * (1 + at[0, 0])
    return found.select("station_id", "pollutant", F.col("rows").alias("n"), (F.greatest(*map(F.abs, left)) < scale).alias("solved"),
                        *(v.alias(f"p{i}_{j}") for (i, j), v in at.items()))


@register("arima_forecast_rows", f"""SELECT station_id, pollutant, {text_time('timestamp_utc')}, {snap('value')} AS y_true, TRUE AS follows
    FROM (SELECT *, count(*) FILTER (WHERE timestamp_utc < cutoff) OVER s AS before, count(value) FILTER (WHERE timestamp_utc < cutoff) OVER s AS readings,
      count(*) FILTER (WHERE timestamp_utc >= cutoff) OVER s AS steps FROM ({SPANS}) WINDOW s AS (PARTITION BY station_id, pollutant))
    WHERE timestamp_utc >= cutoff AND before >= {arima.MIN_TRAIN_ROWS} AND steps >= {arima.MIN_TEST_ROWS} AND readings > 0""")
def _(spark, sf):
    """Every hour of every test span, and whether its forecast follows from the two before by the model's equation.

    Shocks are known for two steps only; from the fourth on, a step is made of the two steps before it.
    """
    hours, cutoffs = series_tables(spark, sf)
    fitted = staged(arima.fitted_series(hours, cutoffs), "fitted")
    rows = arima.station_forecasts(hours, cutoffs, fitted=fitted).join(fitted.select("station_id", "pollutant", "coefficients"), ["station_id", "pollutant"])
    whole = "over (partition by station_id, pollutant order by timestamp_utc)"
    steps = rows.selectExpr("*", *(f"lag(y_pred, {k}) {whole} as y{k}" for k in (1, 2, 3)), f"row_number() {whole} as i")
    made = "coefficients[0] * (y1 - y2) + coefficients[1] * (y2 - y3)"
    return steps.selectExpr("station_id", "pollutant", "timestamp_utc", "y_true",
                            f"coalesce(i < 4 or abs(y_pred - y1 - ({made})) <= 1e-6 * (1 + abs(y_pred)), false) as follows")


@register("train_pollutant")
def _(spark, sf):
    _, metrics = trained(spark, sf, BOOSTED + FOREST)
    series = evaluate.regression_metrics(arima_forecasts(spark, sf)).withColumn("model", F.lit("ARIMA"))
    return metrics.unionByName(series)


@register("model_store")
def _(spark, sf):
    """Predictions of the published models on the test rows."""
    table = stored_features(spark, sf)
    _, test, _ = evaluate.time_split(table)
    return training.predictions(test, trained(spark, sf, table=table)[0])


@register("batch_predict")
def _(spark, sf):
    # Requests carry no weather, which the forest cannot do without: only the boosted trees can score.
    fitted, metrics = trained(spark, sf)
    responses, _ = scoring.batch_predict(A.scoring_requests(spark, sf), fitted, metrics)
    return responses.select("request_id", "pollutant", "unit", "prediction_24h_ahead", "model_used", "model_metrics.mae", "prediction_time", "target_time")


# What is determined of the fitted results: rows, ids, times, units, models, limits, and metrics that agree.
TEST_ROWS = "feat f JOIN cut c ON f.pollutant = c.pollutant AND f.timestamp_utc >= c.cutoff"
UNIT = "CASE pollutant WHEN 'pm25' THEN 'µg/m³' WHEN 'no2' THEN 'ppb' ELSE 'ppm' END AS unit"
ISO = "'%Y-%m-%dT%H:%M:%S+00:00'"


def within(value, pollutant):
    """Whether a forecast keeps to its pollutant's physical bounds, which are fixed values."""
    high = F.when(pollutant == "pm25", 2000.0).when(pollutant == "no2", 500.0).otherwise(0.6)
    return F.coalesce(value.between(F.lit(0.0), high), F.lit(False))


@register("model_store_rows", f"""SELECT f.pollutant, 'GradientBoosting' AS model, station_id, {text_time('f.timestamp_utc', 'timestamp_utc')},
    {snap('f.target')} AS y_true, TRUE AS scored FROM {TEST_ROWS}""")
def _(spark, sf):
    table = stored_features(spark, sf)
    _, test, _ = evaluate.time_split(table)
    rows = training.predictions(test, trained(spark, sf, table=table)[0])
    return rows.select("pollutant", "model", "station_id", "timestamp_utc", "y_true", F.col("y_pred").isNotNull().alias("scored"))


@register("published_metrics", f"""SELECT f.pollutant, 'GradientBoosting' AS model, count(*) AS n_test, TRUE AS mae_agrees, TRUE AS rmse_agrees,
    TRUE AS r2_agrees FROM {TEST_ROWS} GROUP BY f.pollutant""")
def _(spark, sf):
    """Published metrics against sums over what the published models, loaded again, forecast for the test rows."""
    table = stored_features(spark, sf)
    models, metrics = trained(spark, sf, table=table)
    _, test, _ = evaluate.time_split(table)
    off = F.col("y_true") - F.col("y_pred")
    again = training.predictions(test, models).groupBy("pollutant", "model").agg(
        F.avg(F.abs(off)).alias("a"), F.sqrt(F.avg(off * off)).alias("b"), (1 - F.avg(off * off) / F.var_pop("y_true")).alias("c"))
    def agrees(name, value):
        return (F.abs(F.col(name) - F.col(value)) < 1e-4).alias(f"{name}_agrees")
    return metrics.join(again, ["pollutant", "model"]).select(
        "pollutant", "model", "n_test", agrees("mae", "a"), agrees("rmse", "b"), agrees("r2", "c"))


@register("batch_predict_rows", f"""SELECT request_id, pollutant, {UNIT}, 'GradientBoosting' AS model_used, strftime(prediction_time, {ISO}) AS prediction_time,
    strftime(prediction_time + INTERVAL 24 HOUR, {ISO}) AS target_time, TRUE AS within FROM {OK} WHERE used = 'GradientBoosting'""")
def _(spark, sf):
    fitted, metrics = trained(spark, sf)
    responses, _ = scoring.batch_predict(A.scoring_requests(spark, sf), fitted, metrics)
    return responses.select("request_id", "pollutant", "unit", "model_used", "prediction_time", "target_time",
                            within(F.col("prediction_24h_ahead"), F.col("pollutant")).alias("within"))


@register("live_predict")
def _(spark, sf):
    fitted, metrics = trained(spark, sf)
    asked = A.live_requests(spark, sf)
    answers = staged(live.question_answers(asked, A.observations(spark, sf), digits=None), "answers")
    rows = staged(live.answered_features(asked, answers, live_weather(spark, sf), named=False), "live")
    out = scoring.live_predict(rows, fitted, metrics, live.question_sources(answers))
    return out.select("request_id", "pollutant", "unit", "prediction_24h_ahead", "model_used", "prediction_time", "target_time",
                      "data_sources.observations.coverage_hours", "data_sources.feature_summary.live", F.size("warnings").alias("n_warnings"))


@register("model_list", "SELECT DISTINCT pollutant, 'GradientBoosting' AS models FROM pred")
def _(spark, sf):
    _, metrics = trained(spark, sf)
    return scoring.model_inventory(metrics).select("pollutant", F.array_join("available_models", ", ").alias("models"))


@register("weather_ablation")
def _(spark, sf):
    return training.weather_ablation(features.build_features(joined(spark, sf), weather="optional"), FULL)


@register("cached_retrain")
def _(spark, sf):
    """Training reads the feature table that has been stored before."""
    path = scratch_dir(spark, "features")
    hours = staged(joined(spark, sf), "joined")
    training.stored_table(hours, path, features.build_features)
    return training.cached_retrain(hours, path, features.build_features, FULL)[1]


# -- Streaming -----------------------------------------------------------------------------------

def measurement_stream(spark, sf):
    schema = A.table(spark, sf, "events").schema
    events = A.with_station(jobs.read_stream(spark, sf, schema, "events.parquet"))
    return cleaning.measurements(A.raw_rows(events, A.nations(spark, sf))).select("station_id", "pollutant", "timestamp_utc", "value")


def landed(spark, stream, label):
    path = scratch_dir(spark, label)
    jobs.run(jobs.to_table(stream, path, scratch_dir(spark, f"{label}-state")))
    return path


# Hours whose window has closed when the last event is two hours ahead of it.
CLOSED = "(SELECT max(timestamp_utc) - INTERVAL 2 HOUR FROM meas)"
HOURLY = f"""SELECT station_id, pollutant, timestamp_utc, avg(value) AS value, count(value) AS readings FROM meas
    GROUP BY station_id, pollutant, timestamp_utc HAVING timestamp_utc + INTERVAL 1 HOUR <= {CLOSED}"""


@register("stream_hourly_mean", f"SELECT station_id, pollutant, {text_time('timestamp_utc')}, {snap('value')} AS value, readings FROM ({HOURLY})")
def _(spark, sf):
    return spark.read.parquet(landed(spark, jobs.hourly_means(measurement_stream(spark, sf)), "hourly"))


def rolling_sql(width):
    return f"""SELECT * FROM (SELECT station_id, pollutant, {text_time('t', 'timestamp_utc')}, {snap('avg(value)')} AS mean,
    {snap('stddev_pop(value)')} AS std, count(value) AS hours FROM (SELECT *, unnest(generate_series(timestamp_utc + INTERVAL 1 HOUR,
      timestamp_utc + INTERVAL {width} HOUR, INTERVAL 1 HOUR)) AS t FROM ({HOURLY})) WHERE t <= {CLOSED} GROUP BY station_id, pollutant, t) WHERE hours >= 2"""


@register("stream_rolling", rolling_sql(24))
def _(spark, sf):
    return spark.read.parquet(landed(spark, jobs.rolling_means(measurement_stream(spark, sf)), "rolling"))


@register("stream_rolling_168h", rolling_sql(168))
def _(spark, sf):
    return spark.read.parquet(landed(spark, jobs.rolling_means(measurement_stream(spark, sf), 168), "rolling-week"))


@register("late_data", f"""SELECT station_id, pollutant, count(*) AS hours, CAST(sum(readings) AS BIGINT) AS readings FROM ({HOURLY})
    WHERE timestamp_utc >= (SELECT to_timestamp(CAST(floor((epoch(min(timestamp_utc)) + epoch(max(timestamp_utc))) / 2 / 3600) * 3600 AS BIGINT)) FROM meas)::TIMESTAMP
    GROUP BY station_id, pollutant""")
def _(spark, sf):
    """The later half of the readings arrives first; all of the earlier half is then too late."""
    rows = staged(cleaning.measurements(A.raw_long(spark, sf)).select("station_id", "pollutant", "timestamp_utc", "value"), "readings")
    middle = rows.agg(F.timestamp_seconds(F.floor(
        (F.unix_seconds(F.min("timestamp_utc")) + F.unix_seconds(F.max("timestamp_utc"))) / 2 / 3600) * 3600).alias("middle"))
    # The middle is one row.
    split = rows.withColumn("_one", F.lit(1)).join(F.broadcast(middle.withColumn("_one", F.lit(1))), "_one").drop("_one")
    path, out, state = (scratch_dir(spark, label) for label in ("arrivals", "late", "late-state"))
    for late in (False, True):
        arrival = split.filter((F.col("timestamp_utc") < F.col("middle")) == late).drop("middle")
        arrival.write.mode("append").parquet(path)
        jobs.run(jobs.to_table(jobs.hourly_means(jobs.read_stream(spark, path, rows.schema)), out, state))
    return spark.read.parquet(out).groupBy("station_id", "pollutant").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("readings").alias("readings"))


ARRIVALS = 3


def live_arrivals(spark, sf, label, sink):
    """Hourly means arrive in ``ARRIVALS`` spans of time, one run of the stream after each; returns the sink's path."""
    hourly = spark.read.schema("station_id string, pollutant string, timestamp_utc timestamp, value double, readings long").parquet(
        landed(spark, jobs.hourly_means(measurement_stream(spark, sf)), "hourly"))
    seconds = F.unix_seconds("timestamp_utc")
    first, last = hourly.agg(F.min(seconds), F.max(seconds)).first()
    path, out, state = (scratch_dir(spark, name) for name in ("arrivals", label, f"{label}-state"))
    for k in range(ARRIVALS):
        arrival = F.floor((seconds - (first or 0)) * ARRIVALS / ((last or 0) - (first or 0) + 1)) == k
        hourly.filter(arrival).write.mode("append").parquet(path)
        jobs.run(sink(jobs.live_features(jobs.read_stream(spark, path, hourly.schema)), out, state))
    return out


_SERIES = "PARTITION BY station_id, pollutant ORDER BY timestamp_utc"


@register("stream_live_features", f"SELECT station_id, pollutant, {text_time('timestamp_utc')}, {fields(READINGS)} FROM (SELECT station_id, pollutant, timestamp_utc, "
    + ", ".join(f"max(value) OVER ({_SERIES} RANGE BETWEEN INTERVAL {k} HOUR PRECEDING AND INTERVAL {k} HOUR PRECEDING) AS lag_{k}h" for k in (1, 24, 168)) + ", "
    + ", ".join(f"CASE WHEN count(value) OVER w{w} >= 2 THEN {f}(value) OVER w{w} END AS roll_{w}h_{n}" for w in (24, 168) for f, n in (("avg", "mean"), ("stddev_pop", "std")))
    + f" FROM ({HOURLY}) WINDOW " + ", ".join(f"w{w} AS ({_SERIES} RANGE BETWEEN INTERVAL {w} HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)" for w in (24, 168)) + ")")
def _(spark, sf):
    return spark.read.parquet(live_arrivals(spark, sf, "live", jobs.to_table))


@register("stream_score")
def _(spark, sf):
    fitted, _ = trained(spark, sf)
    places = staged(cleaning.station_metadata(cleaning.measurements(A.raw_long(spark, sf))), "places")
    path = live_arrivals(spark, sf, "scores", lambda stream, out, state: jobs.to_batches(
        stream, out, state, lambda batch: jobs.scored(batch, places, fitted)))
    return spark.read.parquet(path).select("station_id", "pollutant", "timestamp_utc", "target_time", "prediction")
