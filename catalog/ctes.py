"""Reference SQL as common table expressions; ``query`` adds the ones a statement needs."""

from __future__ import annotations

import re

from catalog.snap import sql as snap

P = ("pm25", "no2", "ozone")
WX = ("temperature_2m", "wind_speed_10m", "relative_humidity_2m")
LOW_HIGH = {"pm25": (0, 2000), "no2": (0, 500), "ozone": (0, 0.6)}
READINGS = (
    "lag_1h", "lag_24h", "lag_168h", "roll_24h_mean", "roll_24h_std", "roll_168h_mean", "roll_168h_std",
)
CALENDAR = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
BASE = (*READINGS, *CALENDAR, "season", "latitude", "longitude", "drift_flag")


def each(template: str, items=P, sep: str = ", ") -> str:
    return sep.join(template.format(p=p) for p in items)


def text_time(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name or expression}"


def padded(expression: str, width: int) -> str:
    return f"CASE WHEN length({expression}) >= {width} THEN {expression} ELSE lpad({expression}, {width}, '0') END"


def station(a: str, b: str, c: str) -> str:
    return " || ".join(f"({padded(e, w)})" for e, w in ((a, 2), (b, 3), (c, 4)))


def calendar(ts: str, cast: str = "INTEGER") -> str:
    parts = []
    for name, value, period in (
        ("hour", f"hour({ts})", 24), ("dow", f"(isodow({ts}) - 1)", 7), ("month", f"month({ts})", 12),
    ):
        parts += [f"{f}(2 * pi() * {value} / {period}.0) AS {name}_{f}" for f in ("sin", "cos")]
    return ", ".join(parts) + f", CAST(floor((month({ts}) - 1) / 3.0) AS {cast}) AS season"


METEO = "CAST(floor((month({0}) % 12) / 3.0) AS BIGINT)"


def bands(value: str, p: str) -> str:
    limits = {
        "pm25": (12.0, 35.4, 55.4, 150.4, 250.4), "no2": (53.0, 100.0, 360.0, 649.0, 1249.0),
        "ozone": (0.054, 0.070, 0.085, 0.105, 0.200),
    }[p]
    labels = ("Good", "Moderate", "USG", "Unhealthy", "Very Unhealthy")
    cases = " ".join(f"WHEN {value} <= {x} THEN '{y}'" for x, y in zip(limits, labels))
    return f"CASE WHEN {value} IS NULL THEN 'No Data' {cases} ELSE 'Hazardous' END"


W = "PARTITION BY station_id ORDER BY timestamp_utc"


def _filled(p: str) -> str:
    """Value after gap filling; pv, ph, nv, nh are the neighbours and i the hour number."""
    return (
        f"CASE WHEN {p} IS NOT NULL THEN {p} WHEN {p}_ph IS NULL OR i - {p}_ph > 3 THEN NULL "
        f"WHEN {p}_nh IS NULL THEN {p}_pv "
        f"ELSE ({p}_nv - {p}_pv) / ({p}_nh - {p}_ph) * (i - {p}_ph) + {p}_pv END"
    )


CTES: dict[str, str] = {
    "ev": """SELECT event_id, ts, date_trunc('hour', ts) AS hour, user_id, user_id // 30 AS st, event_type, value
        FROM events""",
    "place": """SELECT CAST(n_nationkey AS BIGINT) AS nk, n_name AS state, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw": """SELECT event_id, CAST(st % 50 + 1 AS VARCHAR) AS state_code,
          CAST(st % 7 + 1 AS VARCHAR) AS county_code, CAST(st AS VARCHAR) AS site_number,
          CASE event_type WHEN 'click' THEN '88101' WHEN 'view' THEN '42602' WHEN 'purchase' THEN '44201'
            ELSE '99999' END AS parameter_code, event_type AS parameter,
          event_id % 2 + 1 AS poc,
          CAST(25 + st % 25 AS DOUBLE) AS latitude, CAST(-120 + st % 50 AS DOUBLE) AS longitude,
          CASE WHEN event_id % 997 = 0 THEN 'bad' ELSE strftime(hour, '%Y-%m-%d') END AS date_gmt,
          strftime(hour, '%H:%M') AS time_gmt,
          strftime(hour - INTERVAL 5 HOUR, '%Y-%m-%d') AS date_local,
          strftime(hour - INTERVAL 5 HOUR, '%H:%M') AS time_local,
          CASE WHEN event_id % 211 = 0 THEN -5.0 WHEN event_id % 307 = 0 THEN 9999.0
            WHEN event_type = 'purchase' THEN value / 1000 ELSE value END AS sample_measurement,
          state, region, 'county_' || (st % 7) AS county
        FROM ev JOIN place ON nk = (st % 2) + 5 * (st % 5)""",
    "meas": f"""SELECT {station('state_code', 'county_code', 'site_number')} AS station_id,
          try_strptime(date_gmt || ' ' || time_gmt, '%Y-%m-%d %H:%M') AS timestamp_utc,
          CASE parameter_code WHEN '88101' THEN 'pm25' WHEN '42602' THEN 'no2' ELSE 'ozone' END AS pollutant,
          poc, sample_measurement AS value, latitude, longitude, state, county, region
        FROM raw WHERE parameter_code <> '99999' AND date_gmt <> 'bad'""",
    "meta": """SELECT station_id, min(latitude) AS latitude, min(longitude) AS longitude, min(state) AS state,
          min(county) AS county FROM meas GROUP BY station_id""",
    "wide": f"""SELECT station_id, timestamp_utc, {each("avg(value) FILTER (WHERE pollutant = '{p}') AS {p}")}
        FROM meas GROUP BY station_id, timestamp_utc HAVING count(value) > 0""",
    "rng": """SELECT station_id, min(timestamp_utc) AS a, max(timestamp_utc) AS z FROM wide GROUP BY station_id""",
    "grid": """SELECT station_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS timestamp_utc FROM rng""",
    "norm": f"""SELECT g.station_id, g.timestamp_utc, {each('w.{p}')}, latitude, longitude, state, county,
          epoch(g.timestamp_utc) // 3600 AS i
        FROM grid g LEFT JOIN wide w ON g.station_id = w.station_id AND g.timestamp_utc = w.timestamp_utc
        LEFT JOIN meta m ON g.station_id = m.station_id""",
    "neigh": "SELECT *, " + ", ".join(
        f"""last_value({p} IGNORE NULLS) OVER back AS {p}_pv,
            last_value(CASE WHEN {p} IS NOT NULL THEN i END IGNORE NULLS) OVER back AS {p}_ph,
            first_value({p} IGNORE NULLS) OVER ahead AS {p}_nv,
            first_value(CASE WHEN {p} IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS {p}_nh""" for p in P
    ) + f""" FROM norm WINDOW back AS ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            ahead AS ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "filled": "SELECT station_id, timestamp_utc, latitude, longitude, state, county, "
    + ", ".join(f"{_filled(p)} AS {p}, {p} IS NULL AND ({_filled(p)}) IS NOT NULL AS {p}_interp_flag" for p in P)
    + " FROM neigh",
    "bounded": "SELECT station_id, timestamp_utc, latitude, longitude, state, county, " + ", ".join(
        f"""coalesce({p} < 0, false) AS {p}_neg_flag,
            coalesce({p} < {LOW_HIGH[p][0]} OR {p} > {LOW_HIGH[p][1]}, false) AS {p}_bounds_flag,
            CASE WHEN {p} BETWEEN {LOW_HIGH[p][0]} AND {LOW_HIGH[p][1]} THEN {p} END AS {p}, {p}_interp_flag"""
        for p in P
    ) + " FROM filled",
    "clean": "SELECT *, " + ", ".join(
        f"""coalesce(count({p}) OVER c >= 24
            AND abs({p} - avg({p}) OVER c) / nullif(stddev_samp({p}) OVER c, 0) > 3.5, false) AS {p}_drift_flag"""
        for p in P
    ) + f" FROM bounded WINDOW c AS ({W} ROWS BETWEEN 84 PRECEDING AND 83 FOLLOWING)",
    "wx": """SELECT station_id, hour AS timestamp_utc,
          CASE WHEN i % 97 <> 0 THEN 15 + 10 * sin(2.0 * 3.141592653589793 * hour(hour) / 24.0) END AS temperature_2m,
          2.0 + st % 5 + cos(2.0 * 3.141592653589793 * hour(hour) / 24.0) AS wind_speed_10m,
          50.0 + i % 40 AS relative_humidity_2m
        FROM (SELECT DISTINCT st, hour, st * 720 + (epoch(hour) // 3600) % 720 AS i,
              """ + station("CAST(st % 50 + 1 AS VARCHAR)", "CAST(st % 7 + 1 AS VARCHAR)", "CAST(st AS VARCHAR)") + """ AS station_id FROM ev)
        WHERE i % 181 <> 0""",
    "joined": f"""SELECT c.*, {', '.join('w.' + c for c in WX)} FROM clean c LEFT JOIN wx w
        ON c.station_id = w.station_id AND c.timestamp_utc = w.timestamp_utc""",
    "counts": "SELECT station_id, count(*) AS hours, " + ", ".join(
        f"""count({p}) AS {p}_n, count(*) FILTER (WHERE {p}_interp_flag) AS {p}_interp,
            count(*) FILTER (WHERE {p}_neg_flag) AS {p}_neg, count(*) FILTER (WHERE {p}_bounds_flag) AS {p}_bounds,
            count(*) FILTER (WHERE {p}_drift_flag) AS {p}_drift""" for p in P
    ) + " FROM clean GROUP BY station_id",
    "pcounts": " UNION ALL ".join(
        f"""SELECT station_id, '{p}' AS pollutant, hours, {p}_n AS readings, {p}_interp AS interp,
            {p}_neg AS neg, {p}_bounds AS bounds, {p}_drift AS drift FROM counts""" for p in P
    ),
    "feat_all": " UNION ALL ".join(
        f"""SELECT '{p}' AS pollutant, j.station_id, timestamp_utc,
            lag({p}, 1) OVER o AS lag_1h, lag({p}, 24) OVER o AS lag_24h,
            coalesce(lag({p}, 168) OVER o, CASE WHEN count({p}) OVER w >= 84 THEN avg({p}) OVER w END) AS lag_168h,
            CASE WHEN count({p}) OVER d >= 12 THEN avg({p}) OVER d END AS roll_24h_mean,
            CASE WHEN count({p}) OVER d >= 12 THEN stddev_samp({p}) OVER d END AS roll_24h_std,
            CASE WHEN count({p}) OVER w >= 84 THEN avg({p}) OVER w END AS roll_168h_mean,
            CASE WHEN count({p}) OVER w >= 84 THEN stddev_samp({p}) OVER w END AS roll_168h_std,
            {calendar('timestamp_utc')}, latitude, longitude, CAST({p}_drift_flag AS INTEGER) AS drift_flag,
            {', '.join(WX)}, lead({p}, 24) OVER o AS target
          FROM joined j JOIN counts k ON j.station_id = k.station_id AND k.{p}_n >= 200
          WINDOW o AS (PARTITION BY j.station_id ORDER BY timestamp_utc),
            d AS (PARTITION BY j.station_id ORDER BY timestamp_utc ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
            w AS (PARTITION BY j.station_id ORDER BY timestamp_utc ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)"""
        for p in P
    ),
    "feat": "SELECT * FROM feat_all WHERE " + each("{p} IS NOT NULL", ("target", *BASE, *WX), " AND "),
    "nowx": "SELECT * FROM feat_all WHERE " + each("{p} IS NOT NULL", ("target", *BASE), " AND "),
    "cut": """SELECT pollutant, timestamp_utc AS cutoff FROM (
          SELECT pollutant, timestamp_utc, row_number() OVER (PARTITION BY pollutant ORDER BY timestamp_utc) - 1 AS r,
            count(*) OVER (PARTITION BY pollutant) AS n FROM feat)
        WHERE r = CAST(floor(n * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)""",
    "pred": """SELECT f.pollutant, f.station_id, f.timestamp_utc, target AS y_true, lag_24h AS y_pred
        FROM feat f JOIN cut c ON f.pollutant = c.pollutant AND f.timestamp_utc >= c.cutoff""",
    "located": """SELECT p.*, m.state, pl.region FROM pred p JOIN meta m ON p.station_id = m.station_id
        JOIN place pl ON pl.state = m.state""",
    "grp": " UNION ALL ".join(
        f"""SELECT pollutant, '{level}' AS level, {name} AS name, {region} AS region, {states} AS states,
          CASE WHEN count(*) >= 2 THEN round(avg(abs(y_true - y_pred)), 4) END AS mae,
          CASE WHEN count(*) >= 2 THEN round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 4) END AS rmse,
          CASE WHEN count(*) >= 2 THEN round(CASE WHEN var_pop(y_true) > 0
            THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))
            WHEN sum(abs(y_true - y_pred)) = 0 THEN 1.0 ELSE 0.0 END, 4) END AS r2,
          count(*) AS n_test, count(DISTINCT station_id) AS n_stations
          FROM located GROUP BY {keys}"""
        for level, name, region, states, keys in (
            ("overall", "'all'", "NULL", "NULL", "pollutant"),
            ("state", "state", "min(region)", "NULL", "pollutant, state"),
            ("region", "region", "region", "array_to_string(list_sort(list(DISTINCT state)), ', ')", "pollutant, region"),
        )
    ),
    "obs": """SELECT event_id, CAST((25 + st % 25) * 100 + user_id % 30 AS DOUBLE) / 100 AS latitude,
          CAST((-120 + st % 50) * 100 + user_id % 30 AS DOUBLE) / 100 AS longitude, hour AS timestamp_utc,
          CASE event_type WHEN 'click' THEN 'PM2.5' WHEN 'view' THEN 'NO2' WHEN 'purchase' THEN 'OZONE' ELSE 'CO' END AS parameter,
          CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_type = 'click' THEN 'UG/M3' ELSE 'PPB' END END AS unit,
          CASE WHEN event_id % 5 = 0 AND event_id % 401 = 0 THEN NULL
            WHEN event_id % 211 = 0 THEN NULL WHEN value >= 0 THEN value END AS value,
          CASE WHEN event_id % 13 <> 0 THEN 'site_' || user_id END AS site_name,
          lpad(CAST(user_id AS VARCHAR), 9, '0') AS site_code
        FROM ev WHERE event_id % 997 <> 0""",
    "live_req": """SELECT (st * 100 + day(d)) * 3 + k.i AS request_id, k.pollutant,
          CAST(25 + st % 25 AS DOUBLE) AS latitude, CAST(-120 + st % 50 AS DOUBLE) AS longitude, end_hour
        FROM (SELECT st, CAST(hour AS DATE) AS d, max(hour) AS end_hour FROM ev GROUP BY ALL)
        CROSS JOIN (VALUES (0, 'pm25'), (1, 'no2'), (2, 'ozone')) k(i, pollutant)""",
    "near": """SELECT r.request_id, r.pollutant, o.*, o.parameter = CASE r.pollutant WHEN 'pm25' THEN 'PM2.5'
            WHEN 'no2' THEN 'NO2' ELSE 'OZONE' END AS mine
        FROM live_req r JOIN obs o
          ON o.latitude BETWEEN round(r.latitude - 0.15, 4) AND round(r.latitude + 0.15, 4)
          AND o.longitude BETWEEN round(r.longitude - 0.18, 4) AND round(r.longitude + 0.18, 4)
          AND o.timestamp_utc BETWEEN r.end_hour - INTERVAL 170 HOUR AND r.end_hour""",
    "area": """SELECT request_id, pollutant, timestamp_utc,
          avg(value) FILTER (WHERE mine) / CASE WHEN pollutant = 'ozone' THEN 1000.0 ELSE 1.0 END AS value
        FROM near GROUP BY request_id, pollutant, timestamp_utc""",
    "cover": """SELECT r.request_id, r.pollutant, count(n.request_id) AS n_raw_obs,
          coalesce(max(a.c), 0) AS coverage_hours,
          CASE WHEN count(*) FILTER (WHERE n.mine) > 0 THEN 171 - coalesce(max(a.c), 0) ELSE 0 END AS missing_hours,
          count(*) FILTER (WHERE n.mine) AS n_mine,
          coalesce(array_to_string(list_sort(list(DISTINCT n.site_name) FILTER (WHERE n.mine AND n.site_name IS NOT NULL)), ', '), '') AS sources,
          coalesce(array_to_string(list_sort(list(DISTINCT n.parameter) FILTER (WHERE n.parameter IS NOT NULL)), ', '), '') AS parameters_seen
        FROM live_req r LEFT JOIN near n ON n.request_id = r.request_id
        LEFT JOIN (SELECT request_id, count(value) AS c FROM area GROUP BY request_id) a ON a.request_id = r.request_id
        GROUP BY ALL""",
    "latest": """SELECT request_id, max(timestamp_utc) FILTER (WHERE value IS NOT NULL) AS t0 FROM area GROUP BY request_id""",
    "live": """SELECT r.request_id, r.pollutant, r.latitude, r.longitude, l.t0,
          max(value) FILTER (WHERE timestamp_utc = t0 - INTERVAL 1 HOUR) AS lag_1h,
          max(value) FILTER (WHERE timestamp_utc = t0 - INTERVAL 24 HOUR) AS lag_24h,
          max(value) FILTER (WHERE timestamp_utc = t0 - INTERVAL 168 HOUR) AS lag_168h,
          count(value) FILTER (WHERE timestamp_utc >= t0 - INTERVAL 168 HOUR AND timestamp_utc < t0) AS week_count,
          """ + ", ".join(
        f"""CASE WHEN count(value) FILTER (WHERE timestamp_utc >= t0 - INTERVAL {w} HOUR AND timestamp_utc < t0) >= 2
            THEN {f}(value) FILTER (WHERE timestamp_utc >= t0 - INTERVAL {w} HOUR AND timestamp_utc < t0) END AS roll_{w}h_{n}"""
        for w in (24, 168) for f, n in (("avg", "mean"), ("stddev_pop", "std"))
    ) + """ FROM live_req r LEFT JOIN latest l ON l.request_id = r.request_id
        LEFT JOIN area a ON a.request_id = r.request_id GROUP BY ALL""",
    "cur_a": """SELECT event_id AS request_id,
          CASE WHEN event_id % 11 = 0 THEN 'Parse error: temp' END AS error,
          CASE WHEN event_id % 7 <> 0 THEN value END AS temp, CASE WHEN event_id % 3 <> 0 THEN value / 8 ELSE 0.0 END AS wind,
          CASE WHEN event_id % 5 <> 0 THEN event_id % 100 END AS humidity,
          CASE WHEN event_id % 13 <> 0 THEN event_type ELSE 'unknown' END AS conditions,
          CASE WHEN event_id % 17 <> 0 THEN 'city_' || st ELSE 'unknown' END AS station_name
        FROM ev""",
    "cur_b": """SELECT event_id AS request_id, CASE WHEN event_id % 9 = 0 THEN 'Parse error: temperature_2m' END AS error,
          value / 10 AS temp, 3.5 AS wind, CAST(event_id % 90 AS DOUBLE) AS humidity
        FROM ev WHERE event_id % 4 <> 0""",
    "req": """SELECT event_id AS request_id,
          CASE event_type WHEN 'click' THEN 'pm25' WHEN 'view' THEN 'no2' WHEN 'purchase' THEN 'ozone'
            WHEN 'error' THEN 'so2' ELSE 'pm25' END AS pollutant,
          CASE WHEN event_id % 4 = 1 THEN 'GradientBoosting' WHEN event_id % 4 = 2 THEN 'RandomForest'
            WHEN event_id % 40 = 3 THEN 'Other' END AS model,
          value - 20 AS latitude, value * 2 - 100 AS longitude,
          CASE WHEN event_id % 17 <> 0 THEN value END AS lag_1h, CASE WHEN event_id % 19 <> 0 THEN value * 0.5 END AS lag_24h,
          CASE WHEN event_id % 5 <> 0 THEN value * 0.25 END AS lag_168h,
          CASE WHEN event_id % 7 <> 0 THEN value * 0.75 END AS roll_24h_mean,
          CASE WHEN event_id % 7 <> 0 THEN value * 0.125 END AS roll_24h_std, value * 0.625 AS roll_168h_mean,
          value * 0.0625 AS roll_168h_std,
          CASE WHEN event_id % 23 = 0 THEN 2 ELSE event_id % 2 END AS drift_flag, hour AS prediction_time
        FROM ev""",
    "req_checked": """SELECT *, concat_ws('; ',
          CASE WHEN pollutant NOT IN ('pm25', 'no2', 'ozone') THEN 'pollutant: not one of pm25, no2, ozone' END,
          CASE WHEN model NOT IN ('GradientBoosting', 'RandomForest') THEN 'model: not one of GradientBoosting, RandomForest' END,
          CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'station.latitude: required, between -90 and 90' END,
          CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'station.longitude: required, between -180 and 180' END,
          CASE WHEN lag_1h IS NULL THEN 'readings.lag_1h: required' END,
          CASE WHEN lag_24h IS NULL THEN 'readings.lag_24h: required' END,
          CASE WHEN drift_flag NOT IN (0, 1) THEN 'readings.drift_flag: must be 0 or 1' END
        ) AS errors FROM req""",
}

_NAMES = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)\b", re.IGNORECASE)


def query(body: str) -> str:
    """The statement with every CTE it names, directly or not, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + body


def fields(names, digits: int = 6) -> str:
    return ", ".join(f"{snap(n, digits)} AS {n}" for n in names)
