"""Weather, features, split, evaluation, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import adapter as A
from catalog.cleaning_queries import KEYS, clean, normal, wide
from catalog.ctes import BASE, CALENDAR, METEO, P, READINGS, WX, bands, calendar, each, fields, text_time
from catalog.registry import register
from catalog.snap import sql as snap
from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import cleaning, evaluate, exports, features, weather
from hourgrid.plans.staging import staged


def joined(spark, sf):
    return weather.join_weather(clean(spark, sf), A.weather(spark, sf))


def places(spark, sf):
    return evaluate.station_places(clean(spark, sf), A.regions(spark, sf))


def feats(spark, sf):
    return features.build_features(joined(spark, sf))


def stored_features(spark, sf):
    """The feature table as later steps find it: written once, like the joined table before it."""
    return staged(features.build_features(staged(joined(spark, sf), "joined")), "features")


def predictions(spark, sf):
    _, test, _ = evaluate.time_split(stored_features(spark, sf))
    return staged(evaluate.persistence(test), "predictions")


def groups(spark, sf):
    return evaluate.metrics_by_group(evaluate.geo_join(predictions(spark, sf), places(spark, sf)))


# -- Weather -------------------------------------------------------------------------------------

WEATHER = f"SELECT {KEYS}, {fields(WX)} FROM {{}}"


@register("weather_join", WEATHER.format("joined"))
def _(spark, sf):
    return joined(spark, sf).select("station_id", "timestamp_utc", *WX)


@register("explode_parallel_arrays", f"""SELECT {KEYS}, {fields(WX[:2])},
    {snap('CASE WHEN day(wx.timestamp_utc) % 7 <> 0 THEN relative_humidity_2m END')} AS relative_humidity_2m FROM wx""")
def _(spark, sf):
    return weather.explode_hourly_payload(A.weather_payloads(spark, sf))


@register("flatten_current_weather", f"""SELECT request_id,
    CASE WHEN error IS NULL THEN {snap('temp', 2)} END AS temp_c, CASE WHEN error IS NULL THEN {snap('wind', 2)} END AS wind_ms,
    CASE WHEN error IS NULL THEN CAST(humidity AS DOUBLE) END AS humidity_pct,
    CASE WHEN error IS NULL THEN conditions END AS conditions, CASE WHEN error IS NULL THEN station_name END AS station_name,
    error FROM (SELECT request_id, error, {snap('round_even(temp, 1)', 6)} AS temp,
      (floor(wind * 10 + 0.5) - CASE WHEN floor(wind * 10 + 0.5) = wind * 10 + 0.5 AND floor(wind * 10 + 0.5) % 2 = 1 THEN 1 ELSE 0 END) / 10 AS wind,
      humidity, conditions, station_name FROM
      (SELECT * REPLACE ((floor(temp * 10 + 0.5) - CASE WHEN floor(temp * 10 + 0.5) = temp * 10 + 0.5 AND floor(temp * 10 + 0.5) % 2 = 1 THEN 1 ELSE 0 END) / 10 AS temp) FROM cur_a))""")
def _(spark, sf):
    flat = weather.flatten_current(A.current_payloads(spark, sf)).drop("payload")
    from catalog.snap import snap as cut
    return flat.select(
        "request_id", cut(F.col("temp_c"), 2).alias("temp_c"), cut(F.col("wind_speed_ms"), 2).alias("wind_ms"),
        F.col("humidity_pct").cast("double").alias("humidity_pct"), "conditions", "station_name", "error",
    )


@register("weather_fallback", f"""SELECT e.event_id AS request_id,
    {snap("CASE WHEN a.error IS NULL THEN (floor(a.temp * 10 + 0.5) - CASE WHEN floor(a.temp * 10 + 0.5) = a.temp * 10 + 0.5 AND floor(a.temp * 10 + 0.5) % 2 = 1 THEN 1 ELSE 0 END) / 10 WHEN b.request_id IS NOT NULL AND b.error IS NULL THEN b.temp END")} AS temperature_2m,
    {snap("CASE WHEN a.error IS NULL THEN (floor(a.wind * 10 + 0.5) - CASE WHEN floor(a.wind * 10 + 0.5) = a.wind * 10 + 0.5 AND floor(a.wind * 10 + 0.5) % 2 = 1 THEN 1 ELSE 0 END) / 10 WHEN b.request_id IS NOT NULL AND b.error IS NULL THEN b.wind END")} AS wind_speed_10m,
    {snap("CASE WHEN a.error IS NULL THEN CAST(a.humidity AS DOUBLE) WHEN b.request_id IS NOT NULL AND b.error IS NULL THEN b.humidity END")} AS relative_humidity_2m,
    CASE WHEN a.error IS NULL THEN 'provider A' WHEN b.request_id IS NOT NULL AND b.error IS NULL THEN 'provider B'
      ELSE 'all weather sources failed' END AS weather_source,
    CASE WHEN a.error IS NOT NULL AND (b.request_id IS NULL OR b.error IS NOT NULL)
      THEN 'all weather sources failed: ' || coalesce(b.error, 'no answer') END AS weather_error
    FROM ev e JOIN cur_a a ON a.request_id = e.event_id LEFT JOIN cur_b b ON b.request_id = e.event_id""")
def _(spark, sf):
    asked = A.events(spark, sf).select(F.col("event_id").alias("request_id"))
    return weather.weather_fallback(
        asked, weather.flatten_current(A.current_payloads(spark, sf)),
        weather.flatten_current_forecast(A.forecast_payloads(spark, sf)),
    )


@register("join_coverage", f"""SELECT CAST(sum(h) AS BIGINT) AS total_rows, CAST(sum(w) AS BIGINT) AS rows_with_weather,
    {snap('round(sum(w) / sum(h) * 100, 2)')} AS coverage_pct, count(*) FILTER (WHERE w > 0) AS stations_with_weather,
    count(*) FILTER (WHERE w = 0) AS stations_without_weather
    FROM (SELECT count(*) AS h, count(temperature_2m) AS w FROM joined GROUP BY station_id)""")
def _(spark, sf):
    return weather.coverage(joined(spark, sf))


@register("null_rates", "SELECT " + ", ".join(
    f"{snap(f'round(avg(CAST({c} IS NULL AS INTEGER)) * 100, 1)')} AS {c}_null_pct" for c in WX
) + f", {snap('round(avg(CAST(' + ' OR '.join(f'{c} IS NULL' for c in WX) + ' AS INTEGER)) * 100, 2)')} AS any_null_pct FROM joined")
def _(spark, sf):
    return weather.null_rates(joined(spark, sf))


# -- Calendar and scalar features ----------------------------------------------------------------

@register("cyclical", f"SELECT {KEYS}, {fields(CALENDAR)} FROM (SELECT station_id, timestamp_utc, {calendar('timestamp_utc')} FROM wide)")
def _(spark, sf):
    hours = wide(spark, sf).select("station_id", "timestamp_utc")
    return hours.withColumns(S.calendar_features(F.col("timestamp_utc"))).drop("season")


@register("season_quarter", "SELECT o_orderkey, CAST(floor((month(o_orderdate) - 1) / 3.0) AS BIGINT) AS season FROM orders")
def _(spark, sf):
    rows = A.table(spark, sf, "orders")
    return rows.select("o_orderkey", S.season_quarter(F.month("o_orderdate")).alias("season"))


@register("season_meteo", f"SELECT o_orderkey, {METEO.format('o_orderdate')} AS season FROM orders")
def _(spark, sf):
    rows = A.table(spark, sf, "orders")
    return rows.select("o_orderkey", S.season_meteo(F.month("o_orderdate")).alias("season"))


@register("drift_int", f"SELECT {KEYS}, {each('CAST({p}_drift_flag AS BIGINT) AS {p}_drift')} FROM clean")
def _(spark, sf):
    return clean(spark, sf).select("station_id", "timestamp_utc", *(F.col(f"{p}_drift_flag").cast("int").alias(f"{p}_drift") for p in P))


@register("aqi_category", f"SELECT {KEYS}, " + ", ".join(f"{bands(p, p)} AS {p}_category" for p in P) + " FROM wide")
def _(spark, sf):
    return wide(spark, sf).select("station_id", "timestamp_utc", *(S.category(F.col(p), p).alias(f"{p}_category") for p in P))


CLIP = "CASE WHEN pollutant = 'pm25' THEN {0} WHEN pollutant = 'no2' THEN {1} ELSE {2} END"


@register("clip_prediction", f"""SELECT event_id, {snap(f"greatest(0.0, least(v, {CLIP.format('2000.0', '500.0', '0.6')}))")} AS value
    FROM (SELECT event_id, sample_measurement * 2 AS v, CASE parameter_code WHEN '88101' THEN 'pm25' WHEN '42602' THEN 'no2' ELSE 'ozone' END AS pollutant
      FROM raw WHERE parameter_code <> '99999')""")
def _(spark, sf):
    rows = cleaning.keep_parameters(A.raw_long(spark, sf))
    return rows.select("event_id", S.clip(F.col("sample_measurement") * 2, F.col("pollutant"), None).alias("value"))


# Every state name, and two that are in no region, dealt over the customers.
_STATES = [*sorted(state for states in C.CENSUS_REGIONS.values() for state in states), "District", "Elsewhere"]


@register("census_region", f"""SELECT c_custkey, CASE
    WHEN state IN ('Connecticut', 'Maine', 'Massachusetts', 'New Hampshire', 'Rhode Island', 'Vermont', 'New Jersey', 'New York', 'Pennsylvania') THEN 'Northeast'
    WHEN state IN ('Indiana', 'Illinois', 'Michigan', 'Ohio', 'Wisconsin', 'Iowa', 'Kansas', 'Minnesota', 'Missouri', 'Nebraska', 'North Dakota', 'South Dakota') THEN 'Midwest'
    WHEN state IN ('Delaware', 'Florida', 'Georgia', 'Maryland', 'North Carolina', 'South Carolina', 'Virginia', 'District Of Columbia', 'West Virginia', 'Alabama',
      'Kentucky', 'Mississippi', 'Tennessee', 'Arkansas', 'Louisiana', 'Oklahoma', 'Texas') THEN 'South'
    WHEN state IN ('Arizona', 'Colorado', 'Idaho', 'Montana', 'Nevada', 'New Mexico', 'Utah', 'Wyoming', 'Alaska', 'California', 'Hawaii', 'Oregon', 'Washington') THEN 'West'
    ELSE 'Unknown' END AS region FROM (SELECT c_custkey, list_extract([{', '.join(f"'{s}'" for s in _STATES)}], c_custkey % {len(_STATES)} + 1) AS state FROM customer)""")
def _(spark, sf):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("c_custkey") % len(_STATES) + 1).cast("int"))
    return A.table(spark, sf, "customer").select("c_custkey", S.census_region(state).alias("region"))


@register("unit_label", """SELECT event_id, CASE parameter_code WHEN '88101' THEN 'µg/m³' WHEN '42602' THEN 'ppb' ELSE 'ppm' END AS unit
    FROM raw WHERE parameter_code <> '99999'""")
def _(spark, sf):
    return cleaning.keep_parameters(A.raw_long(spark, sf)).select("event_id", S.unit_label(F.col("pollutant")).alias("unit"))


def _pairs(spark, sf):
    """A baseline and an augmented error per order, from its lines."""
    lines = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_discount").alias("base"), F.avg("l_tax").alias("aug"), F.count(F.lit(1)).alias("n"),
    )
    return lines.select("l_orderkey", "n", F.when(F.col("n") > 1, F.col("base")).alias("base"), (F.col("aug") + 0.01).alias("aug"))


PAIRS = """(SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) > 1 THEN avg(CAST(l_discount AS DOUBLE)) END AS base,
    avg(CAST(l_tax AS DOUBLE)) + 0.01 AS aug FROM lineitem GROUP BY l_orderkey)"""


def delta_sql(base, augmented):
    """SQL of the signed difference with its arrow."""
    d = f"({augmented} - {base})"
    return f"""CASE WHEN {d} IS NULL THEN 'n/a' ELSE printf('%+.4f', CAST({d} AS DOUBLE)) || ' ' ||
      CASE WHEN {d} < 0 THEN '↓' WHEN {d} > 0 THEN '↑' ELSE '→' END END"""


@register("verdict_delta", f"""SELECT l_orderkey, {snap('aug - base')} AS delta,
    CASE WHEN base IS NULL THEN 'unknown' WHEN base = 0 THEN 'no change' WHEN (aug - base) / base < -0.005 THEN 'improved'
      WHEN (aug - base) / base > 0.005 THEN 'degraded' ELSE 'no change' END AS verdict,
    {delta_sql('base', 'aug')} AS delta_text FROM {PAIRS}""")
def _(spark, sf):
    base, aug = F.col("base").cast("double"), F.col("aug").cast("double")
    return _pairs(spark, sf).select(
        "l_orderkey", (aug - base).alias("delta"), S.verdict(base, aug).alias("verdict"), S.delta_text(base, aug).alias("delta_text"))


@register("correlation_label", """SELECT l_orderkey, CASE WHEN rho IS NULL THEN 'insufficient data' ELSE
    CASE WHEN abs(rho) >= 0.6 THEN 'strong' WHEN abs(rho) >= 0.3 THEN 'moderate' ELSE 'weak' END || ' ' ||
    CASE WHEN rho < 0 THEN 'negative' ELSE 'positive' END || ' correlation (' ||
    CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END || ' at p<0.05)' END AS label
    FROM (SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN CAST(l_discount AS DOUBLE) * 20 - 1 END AS rho,
      CAST(l_tax AS DOUBLE) AS p, l_linenumber FROM lineitem)""")
def _(spark, sf):
    rho = F.when(F.col("l_linenumber") > 1, F.col("l_discount").cast("double") * 20 - 1)
    return A.table(spark, sf, "lineitem").select(
        "l_orderkey", S.correlation_label(rho, F.col("l_tax").cast("double")).alias("label")
    )


# -- Series --------------------------------------------------------------------------------------

ORDERED = "WINDOW o AS (PARTITION BY station_id ORDER BY timestamp_utc)"


def each_pollutant(build, table):
    """``build(table, pollutant)`` for all pollutants, one below the other; the table is written once."""
    rows = staged(table, "series")
    return exports.union_parts([build(rows, p).withColumn("pollutant", F.lit(p)) for p in P])


def each_sql(body):
    return " UNION ALL ".join(f"SELECT '{p}' AS pollutant, * FROM ({body(p)})" for p in P)


@register("lags", each_sql(lambda p: f"""SELECT {KEYS}, {', '.join(f"{snap(f'lag({p}, {k}) OVER o')} AS lag_{k}h" for k in (1, 24, 168))}
    FROM clean {ORDERED}"""))
def _(spark, sf):
    return each_pollutant(lambda rows, p: features.lags(rows, p).select("station_id", "timestamp_utc", "lag_1h", "lag_24h", "lag_168h"), clean(spark, sf))


@register("target_lead", each_sql(lambda p: f"SELECT {KEYS}, {snap(f'lead({p}, 24) OVER o')} AS target FROM clean {ORDERED}"))
def _(spark, sf):
    return each_pollutant(lambda rows, p: features.target_lead(rows, p).select("station_id", "timestamp_utc", "target"), clean(spark, sf))


def _roll(p: str) -> str:
    out = []
    for name, w, n in (("24h", "d", 12), ("168h", "w", 84)):
        out += [f"CASE WHEN count({p}) OVER {w} >= {n} THEN {f}({p}) OVER {w} END AS roll_{name}_{k}" for f, k in (("avg", "mean"), ("stddev_samp", "std"))]
    return ", ".join(out)


ROLLING = """WINDOW o AS (PARTITION BY station_id ORDER BY timestamp_utc),
    d AS (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
    w AS (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"""


@register("rolling_stats", each_sql(lambda p: f"SELECT {KEYS}, {fields(READINGS[3:])} FROM (SELECT station_id, timestamp_utc, {_roll(p)} FROM clean {ROLLING})"))
def _(spark, sf):
    return each_pollutant(lambda rows, p: features.rolling_stats(rows, p).select("station_id", "timestamp_utc", *READINGS[3:]), clean(spark, sf))


@register("impute_lag168", each_sql(lambda p: f"""SELECT {KEYS}, {snap('coalesce(l, roll_168h_mean)')} AS lag_168h
    FROM (SELECT station_id, timestamp_utc, lag({p}, 168) OVER o AS l, {_roll(p)} FROM clean {ROLLING})"""))
def _(spark, sf):
    def imputed(rows, p):
        return features.impute_lag168(features.rolling_stats(features.lags(rows, p), p)).select("station_id", "timestamp_utc", "lag_168h")
    return each_pollutant(imputed, clean(spark, sf))


@register("ffill_bfill", each_sql(lambda p: f"""SELECT {KEYS}, {snap(f'''coalesce(
    last_value({p} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({p} IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY timestamp_utc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS value FROM norm"""))
def _(spark, sf):
    def filled(rows, p):
        return features.fill_both_ways(rows.select("station_id", "timestamp_utc", p), p).withColumnRenamed(p, "value")
    return each_pollutant(filled, normal(spark, sf))


@register("range_stats", each_sql(lambda p: f"""SELECT {KEYS}, {snap(f'CASE WHEN count({p}) OVER d >= 2 THEN avg({p}) OVER d END')} AS mean_24h,
    {snap(f'CASE WHEN count({p}) OVER d >= 2 THEN stddev_pop({p}) OVER d END')} AS std_24h FROM wide
    WINDOW d AS (PARTITION BY station_id ORDER BY timestamp_utc RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)"""))
def _(spark, sf):
    from hourgrid.operators import live
    return each_pollutant(lambda rows, p: live.rolling_range_stats(rows, p, 24, digits=None).select(
        "station_id", "timestamp_utc", "mean_24h", "std_24h"), wide(spark, sf))


@register("min_readings", "SELECT station_id, pollutant, readings FROM pcounts WHERE readings >= 200")
def _(spark, sf):
    return features.eligible_stations(clean(spark, sf))


FEATURE_FIELDS = fields((*READINGS, *CALENDAR, "latitude", "longitude", *WX, "target"))
FEATURE_SQL = f"SELECT pollutant, {KEYS}, {FEATURE_FIELDS}, CAST(season AS BIGINT) AS season, CAST(drift_flag AS BIGINT) AS drift_flag FROM {{}}"


@register("all_features", FEATURE_SQL.format("feat"))
def _(spark, sf):
    return feats(spark, sf)


@register("station_features", FEATURE_SQL.format("feat_all"))
def _(spark, sf):
    return features.feature_rows(joined(spark, sf))


_FULL = " AND ".join(f"{c} IS NOT NULL" for c in ("target", *BASE, *WX))
_PART = " AND ".join(f"{c} IS NOT NULL" for c in ("target", *BASE))


@register("drop_incomplete", f"""SELECT pollutant, count(*) AS rows, count(*) FILTER (WHERE {_FULL}) AS kept,
    count(*) FILTER (WHERE NOT ({_FULL})) AS dropped, count(*) FILTER (WHERE {_PART} AND NOT ({_FULL})) AS dropped_weather_only
    FROM feat_all GROUP BY pollutant""")
def _(spark, sf):
    return features.drop_counts(features.feature_rows(joined(spark, sf)))


@register("weather_feature_audit", f"""SELECT s.pollutant, coalesce(u.usable_rows, 0) AS usable_rows, coalesce(u.stations_used, 0) AS stations_used,
    s.stations_skipped, coalesce(u.weather_null_dropped, 0) AS weather_null_dropped
    FROM (SELECT pollutant, count(*) FILTER (WHERE readings < 200) AS stations_skipped FROM pcounts GROUP BY pollutant) s
    LEFT JOIN (SELECT pollutant, count(*) FILTER (WHERE {_FULL}) AS usable_rows,
      count(DISTINCT CASE WHEN {_FULL} THEN station_id END) AS stations_used,
      count(*) FILTER (WHERE {_PART} AND NOT ({_FULL})) AS weather_null_dropped FROM feat_all GROUP BY pollutant) u
    ON u.pollutant = s.pollutant""")
def _(spark, sf):
    return features.feature_audit(joined(spark, sf))


# -- Split and metrics ---------------------------------------------------------------------------

@register("time_split", f"""SELECT f.pollutant, {text_time('c.cutoff', 'cutoff')},
    count(*) FILTER (WHERE timestamp_utc < cutoff) AS train_rows, count(*) FILTER (WHERE timestamp_utc >= cutoff) AS test_rows
    FROM feat f JOIN cut c ON c.pollutant = f.pollutant GROUP BY f.pollutant, c.cutoff""")
def _(spark, sf):
    train, test, cutoffs = evaluate.time_split(stored_features(spark, sf))
    def sizes(df, name):
        return df.groupBy("pollutant").agg(F.count(F.lit(1)).alias(name))
    return cutoffs.join(sizes(train, "train_rows"), "pollutant", "left").join(
        sizes(test, "test_rows"), "pollutant", "left").na.fill(0, ["train_rows", "test_rows"])


METRICS = f"{snap('mae')} AS mae, {snap('rmse')} AS rmse, {snap('r2')} AS r2, n_test"


@register("regression_metrics", f"SELECT pollutant, {METRICS} FROM grp WHERE level = 'overall'")
def _(spark, sf):
    return evaluate.regression_metrics(predictions(spark, sf))


@register("geo_join", f"SELECT pollutant, {KEYS}, state, region, {fields(('y_true', 'y_pred'))} FROM located")
def _(spark, sf):
    return evaluate.geo_join(predictions(spark, sf), places(spark, sf))


GROUPS = f"SELECT pollutant, level, name, region, states, {METRICS}, n_stations FROM grp"


@register("metrics_by_group", GROUPS)
def _(spark, sf):
    return groups(spark, sf).withColumn("states", F.array_join("states", ", "))


@register("flag_groups", """SELECT g.pollutant, g.level, g.name, coalesce(g.level = 'state' AND g.mae > o.mae * 1.5, false) AS flagged
    FROM grp g JOIN (SELECT pollutant, mae FROM grp WHERE level = 'overall') o ON o.pollutant = g.pollutant""")
def _(spark, sf):
    return evaluate.flag_groups(groups(spark, sf)).select("pollutant", "level", "name", "flagged")


@register("rank_groups", """SELECT pollutant, level, name, row_number() OVER (PARTITION BY pollutant, level ORDER BY mae NULLS LAST, name) AS position
    FROM grp WHERE level <> 'overall'""")
def _(spark, sf):
    return evaluate.rank_groups(groups(spark, sf)).select("pollutant", "level", "name", "position")


BEST = f"""SELECT pollutant, level, first(name ORDER BY mae, name) AS best, {snap('min(mae)')} AS best_mae,
    first(name ORDER BY mae DESC, name) AS worst, {snap('max(mae)')} AS worst_mae,
    {snap('round(max(mae) / nullif(min(mae), 0), 2)')} AS mae_ratio FROM grp WHERE level <> 'overall' AND mae IS NOT NULL GROUP BY pollutant, level"""


@register("best_worst", BEST)
def _(spark, sf):
    return evaluate.best_worst(groups(spark, sf))


def _terms(count, even):
    """SQL of the finite sum of Student's distribution for an even or odd number of degrees of freedom."""
    ratio = "lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi())" if even else "lgamma(k + 1) + 0.5 * ln(pi()) - ln(2) - lgamma(k + 1.5)"
    return f"coalesce(list_sum(list_transform(range({count}), lambda k: exp({ratio}) * pow(1 - rho * rho, k + {0 if even else 0.5}))), 0)"


#: Rank correlation of a state's error with its size, and its two-sided p value from the finite sums.
SPEARMAN = f"""(SELECT pollutant, n, rho, CASE WHEN n < 3 OR rho IS NULL THEN NULL WHEN abs(rho) >= 1 THEN 0.0
      WHEN n % 2 = 0 THEN 1 - abs(rho) * {_terms('CAST((n - 2) // 2 AS BIGINT)', True)}
      ELSE 1 - 2 / pi() * (asin(abs(rho)) + abs(rho) * {_terms('CAST((n - 3) // 2 AS BIGINT)', False)}) END AS p_value FROM (
    SELECT pollutant, count(*) AS n, CASE WHEN count(*) >= 4 THEN corr(x, y) END AS rho FROM (
      SELECT pollutant, rank() OVER (PARTITION BY pollutant ORDER BY n_test) + (count(*) OVER (PARTITION BY pollutant, n_test) - 1) / 2.0 AS x,
        rank() OVER (PARTITION BY pollutant ORDER BY mae) + (count(*) OVER (PARTITION BY pollutant, mae) - 1) / 2.0 AS y
      FROM grp WHERE level = 'state' AND mae IS NOT NULL) GROUP BY pollutant))"""


@register("disparity", " ".join(["SELECT b.pollutant,"] + [
    ", ".join(f"max(b.{f}) FILTER (WHERE b.level = '{lv}') AS {lv}_{f}" for lv in ("state", "region") for f in ("best", "best_mae", "worst", "worst_mae", "mae_ratio"))
] + [f""", coalesce(max(m.names), '') AS flagged_states, {snap('max(round(r.rho, 3))')} AS rho, {snap('max(round(r.p_value, 4))')} AS p_value,
    max(CASE WHEN r.rho IS NULL THEN 'insufficient data' ELSE CASE WHEN abs(r.rho) >= 0.6 THEN 'strong' WHEN abs(r.rho) >= 0.3 THEN 'moderate' ELSE 'weak' END
      || CASE WHEN r.rho < 0 THEN ' negative' ELSE ' positive' END || ' correlation (' || CASE WHEN r.p_value < 0.05 THEN '' ELSE 'not ' END || 'significant at p<0.05)' END) AS interpretation,
    CAST(1.5 AS DOUBLE) AS flag_threshold_ratio FROM ({BEST}) b LEFT JOIN (
    SELECT g.pollutant, string_agg(g.name, ', ' ORDER BY g.name) AS names FROM grp g
    JOIN (SELECT pollutant, mae FROM grp WHERE level = 'overall') o ON o.pollutant = g.pollutant
    WHERE g.level = 'state' AND g.mae > o.mae * 1.5 GROUP BY g.pollutant) m ON m.pollutant = b.pollutant
    LEFT JOIN {SPEARMAN} r ON r.pollutant = b.pollutant GROUP BY b.pollutant"""]))
def _(spark, sf):
    return evaluate.disparity(groups(spark, sf)).withColumn("flagged_states", F.array_join("flagged_states", ", "))


@register("spearman", f"SELECT pollutant, n, {snap('rho')} AS rho, {snap('p_value')} AS p_value FROM {SPEARMAN}")
def _(spark, sf):
    states = groups(spark, sf).filter(F.col("level") == "state")
    return evaluate.spearman(states, "n_test", "mae")


@register("bias_audit", f"""SELECT g.pollutant, level, name, region, states, {snap('g.mae')} AS mae, {snap('rmse')} AS rmse, {snap('r2')} AS r2,
    n_test, n_stations, coalesce(level = 'state' AND g.mae > o.mae * 1.5, false) AS flagged,
    CASE WHEN level <> 'overall' THEN row_number() OVER (PARTITION BY g.pollutant, level ORDER BY g.mae NULLS LAST, name) ELSE 0 END AS position
    FROM grp g JOIN (SELECT pollutant, mae FROM grp WHERE level = 'overall') o ON o.pollutant = g.pollutant""")
def _(spark, sf):
    from hourgrid.plans import audit
    out = audit.group_report(predictions(spark, sf), places(spark, sf))
    return out.withColumn("states", F.array_join("states", ", "))


@register("ordered_distinct", "SELECT DISTINCT m.state, region FROM meta m JOIN place ON place.state = m.state ORDER BY m.state")
def _(spark, sf):
    return evaluate.state_regions(places(spark, sf))


# -- Exports -------------------------------------------------------------------------------------

MEANS = ", ".join(f"{snap(f'avg({p})')} AS {p}_mean" for p in P)
DAILY = f"""SELECT station_id, strftime(timestamp_utc, '%Y-%m-%d') AS date, state, county, latitude, longitude,
    CAST(month(timestamp_utc) AS BIGINT) AS month, {METEO.format('timestamp_utc')} AS season, {MEANS}
    FROM clean GROUP BY ALL HAVING count(pm25) + count(no2) + count(ozone) > 0"""


@register("daily_station", DAILY)
def _(spark, sf):
    return exports.daily_station(clean(spark, sf), digits=None)


@register("monthly_state", f"""SELECT state, strftime(timestamp_utc, '%Y-%m') AS year_month, CAST(month(timestamp_utc) AS BIGINT) AS month,
    {METEO.format('timestamp_utc')} AS season, {MEANS},
    {each('count(DISTINCT CASE WHEN {p} IS NOT NULL THEN station_id END) AS stations_{p}')} FROM clean GROUP BY ALL""")
def _(spark, sf):
    return exports.monthly_state(clean(spark, sf), digits=None)


@register("means_counts_join", f"""SELECT a.state, a.year_month, {each('a.{p}_mean')}, {each('b.stations_{p}')} FROM
    (SELECT state, strftime(timestamp_utc, '%Y-%m') AS year_month, {MEANS} FROM clean GROUP BY ALL) a LEFT JOIN
    (SELECT state, strftime(timestamp_utc, '%Y-%m') AS year_month, {each('count(DISTINCT CASE WHEN {p} IS NOT NULL THEN station_id END) AS stations_{p}')}
     FROM clean GROUP BY ALL) b ON a.state = b.state AND a.year_month = b.year_month""")
def _(spark, sf):
    return exports.monthly_state(clean(spark, sf), digits=None).drop("month", "season")


ANNUAL = f"""SELECT station_id, state, county, latitude, longitude, {', '.join(f"{snap(f'avg({p})')} AS avg_{p}" for p in P)},
    {', '.join(f"{bands(f'avg({p})', p)} AS aqi_cat_{p}" for p in P)} FROM clean GROUP BY station_id, state, county, latitude, longitude"""


@register("station_annual", ANNUAL)
def _(spark, sf):
    return exports.station_annual(clean(spark, sf), digits=None)


@register("category_distribution", " UNION ALL ".join(f"""SELECT '{p}' AS pollutant, category, count(*) AS stations,
    CAST(list_position(['Good', 'Moderate', 'USG', 'Unhealthy', 'Very Unhealthy', 'Hazardous', 'No Data'], category) - 1 AS BIGINT) AS position
    FROM (SELECT {bands(f'avg({p})', p)} AS category FROM clean GROUP BY station_id) GROUP BY category""" for p in P))
def _(spark, sf):
    return exports.category_distribution(exports.station_annual(clean(spark, sf)))


@register("bundle_inventory", """SELECT CAST(1 AS BIGINT) AS position, 'Hours' AS name, count(*) AS rows, 'station_id, timestamp_utc, pm25, no2, ozone' AS columns FROM wide
    UNION ALL SELECT 2, 'Stations', count(*), 'station_id, first_hour, last_hour' FROM rng
    UNION ALL SELECT 3, 'Regions', count(*), 'state, region' FROM place""")
def _(spark, sf):
    hours = wide(spark, sf)
    return exports.bundle_inventory({
        "Hours": hours, "Stations": cleaning.station_range(hours), "Regions": A.regions(spark, sf),
    })


def _metrics_document(spark, sf):
    """One JSON document of persistence metrics per station."""
    rows = evaluate.regression_metrics(predictions(spark, sf), ("pollutant", "station_id"), None)
    by_model = rows.select("station_id", "pollutant", F.create_map(
        F.concat(F.lit("persistence_"), F.col("station_id")), F.struct("mae", "rmse", "r2", "n_test")).alias("m"))
    return by_model.groupBy("station_id").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("pollutant", "m")))).alias("document"))


BY_STATION = """(SELECT pollutant, station_id, count(*) AS n_test, CASE WHEN count(*) >= 2 THEN avg(abs(y_true - y_pred)) END AS mae,
    CASE WHEN count(*) >= 2 THEN sqrt(avg((y_true - y_pred) * (y_true - y_pred))) END AS rmse,
    CASE WHEN count(*) >= 2 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END AS r2
    FROM pred GROUP BY pollutant, station_id)"""


@register("flatten_metrics", f"SELECT pollutant, 'persistence_' || station_id AS model, {METRICS} FROM {BY_STATION}")
def _(spark, sf):
    return exports.flatten_metrics(_metrics_document(spark, sf))


def _audit_document(spark, sf):
    from hourgrid.plans import audit
    return audit.audit_document(audit.group_report(predictions(spark, sf), places(spark, sf)))


@register("flatten_audit", f"""SELECT pollutant, name AS state, region, {METRICS}, n_stations,
    coalesce(mae > max(CASE WHEN level = 'overall' THEN mae END) OVER (PARTITION BY pollutant) * 1.5, false) AS flagged FROM grp
    QUALIFY level = 'state'""")
def _(spark, sf):
    return exports.flatten_audit_states(_audit_document(spark, sf))


@register("flatten_audit_regions", f"SELECT pollutant, name AS region, states, {METRICS}, n_stations FROM grp WHERE level = 'region'")
def _(spark, sf):
    return exports.flatten_audit_regions(_audit_document(spark, sf))


def _two_models(spark, sf):
    """Metrics of two deterministic forecasts under two model names."""
    _, test, _ = evaluate.time_split(stored_features(spark, sf))
    a = evaluate.regression_metrics(evaluate.persistence(test))
    b = evaluate.regression_metrics(test.select("pollutant", F.col("target").alias("y_true"), F.col("roll_24h_mean").alias("y_pred")))
    return a.withColumn("model", F.lit("GradientBoosting")), b.withColumn("model", F.lit("RandomForest"))


MEAN_METRICS = """(SELECT f.pollutant, round(avg(abs(target - roll_24h_mean)), 4) AS mae,
    round(sqrt(avg((target - roll_24h_mean) * (target - roll_24h_mean))), 4) AS rmse,
    round(1 - sum((target - roll_24h_mean) * (target - roll_24h_mean)) / (var_pop(target) * count(*)), 4) AS r2, count(*) AS n_test
    FROM feat f JOIN cut c ON f.pollutant = c.pollutant AND f.timestamp_utc >= c.cutoff GROUP BY f.pollutant)"""
OVERALL = "(SELECT pollutant, mae, rmse, r2, n_test FROM grp WHERE level = 'overall')"


@register("model_comparison", "SELECT a.pollutant, " + ", ".join(
    f"{snap(f'{t}.{k}')} AS {m}_{k}" for t, m in (("a", "GradientBoosting"), ("b", "RandomForest")) for k in ("mae", "rmse", "r2")
) + f" FROM {OVERALL} a JOIN {MEAN_METRICS} b ON a.pollutant = b.pollutant")
def _(spark, sf):
    a, b = _two_models(spark, sf)
    return exports.model_comparison(a.unionByName(b), ("GradientBoosting", "RandomForest"))


@register("metrics_overlay", f"""SELECT pollutant, 'GradientBoosting' AS model, {METRICS} FROM {OVERALL} WHERE pollutant <> 'no2' UNION ALL
    SELECT pollutant, 'RandomForest', {METRICS} FROM {MEAN_METRICS} UNION ALL
    SELECT pollutant, 'GradientBoosting', {METRICS} FROM {MEAN_METRICS} WHERE pollutant = 'no2'""")
def _(spark, sf):
    a, b = _two_models(spark, sf)
    replaced = b.filter(F.col("pollutant") == "no2").withColumn("model", F.lit("GradientBoosting"))
    return exports.metrics_overlay(a, b.unionByName(replaced))


@register("ablation_join", f"""SELECT a.pollutant, {', '.join(f"{snap(f'{t}.{k}')} AS {m}_{k}" for t, m in (('a', 'base'), ('b', 'aug')) for k in ('mae', 'rmse', 'r2'))},
    {', '.join(f"{snap(f'round(b.{k} - a.{k}, 4)')} AS delta_{k}" for k in ('mae', 'rmse', 'r2'))},
    {delta_sql('a.mae', 'b.mae')} AS delta_text,
    CASE WHEN (b.mae - a.mae) / a.mae < -0.005 THEN 'improved' WHEN (b.mae - a.mae) / a.mae > 0.005 THEN 'degraded' ELSE 'no change' END AS verdict
    FROM {OVERALL} a LEFT JOIN {MEAN_METRICS} b ON a.pollutant = b.pollutant""")
def _(spark, sf):
    a, b = _two_models(spark, sf)
    return exports.ablation(a, b)


@register("model_metrics_join", f"""SELECT p.pollutant, {text_time('p.timestamp_utc', 'timestamp_utc')}, p.station_id, {snap('p.y_pred')} AS y_pred,
    {snap('m.mae')} AS mae, m.n_test FROM pred p LEFT JOIN {OVERALL} m ON m.pollutant = p.pollutant""")
def _(spark, sf):
    from hourgrid.plans import scoring
    rows = predictions(spark, sf).drop("y_true").withColumn("model", F.lit("GradientBoosting"))
    return scoring.attach_metrics(rows, _two_models(spark, sf)[0]).select(
        "pollutant", "timestamp_utc", "station_id", "y_pred", "model_metrics.mae", "model_metrics.n_test"
    )


def _timed_runs(spark, sf):
    """Stage times of two paths, one run per customer, from the prices of its orders."""
    return A.table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("slow")).otherwise(F.lit("fast")).alias("path"),
        (F.col("o_totalprice").cast("double") / 100000).alias("load"), (F.col("o_custkey") % 7).cast("double").alias("clean"),
        (F.col("o_orderkey") % 5).cast("double").alias("features"), (F.col("o_totalprice").cast("double") / 50000).alias("train"),
        (F.col("o_totalprice").cast("double") / 10000).alias("total"),
    )


_RUNS = {"load": "CAST(o_totalprice AS DOUBLE) / 100000", "clean": "CAST(o_custkey % 7 AS DOUBLE)", "features": "CAST(o_orderkey % 5 AS DOUBLE)",
         "train": "CAST(o_totalprice AS DOUBLE) / 50000", "total": "CAST(o_totalprice AS DOUBLE) / 10000"}


@register("run_stats", " UNION ALL ".join(f"""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'slow' ELSE 'fast' END AS path, '{k}' AS stage,
    {snap(f'round(avg({e}), 3)')} AS mean_s, {snap(f'round(stddev_pop({e}), 3)')} AS stdev_s, count(*) AS runs FROM orders GROUP BY 1""" for k, e in _RUNS.items()))
def _(spark, sf):
    return exports.run_stats(_timed_runs(spark, sf))


@register("run_savings", " UNION ALL ".join(f"""SELECT '{k}' AS stage, {snap('s')} AS slow_s, {snap('f')} AS fast_s, {snap('round(s - f, 3)')} AS saved_s,
    {snap('round((1 - f / s) * 100, 1)')} AS reduction_pct FROM (SELECT round(avg({e}) FILTER (WHERE o_orderkey % 2 = 0), 3) AS s,
    round(avg({e}) FILTER (WHERE o_orderkey % 2 <> 0), 3) AS f FROM orders)""" for k, e in _RUNS.items()))
def _(spark, sf):
    return exports.run_savings(exports.run_stats(_timed_runs(spark, sf)), "slow", "fast")


@register("union_parts", f"""SELECT {KEYS}, {fields(('pm25', 'no2'))} FROM (SELECT station_id, timestamp_utc, pm25, NULL AS no2 FROM wide
    UNION ALL SELECT station_id, timestamp_utc, NULL, no2 FROM wide)""")
def _(spark, sf):
    hours = wide(spark, sf)
    return exports.union_parts([hours.drop("no2", "ozone"), hours.drop("pm25", "ozone")])


@register("sorted_output", f"SELECT {KEYS}, {fields(P)} FROM wide ORDER BY wide.station_id, wide.timestamp_utc")
def _(spark, sf):
    return exports.sorted_output(wide(spark, sf))
