"""Small tables for the tests."""

from __future__ import annotations

import numpy as np
import pandas as pd

from hourgrid.constants import POLLUTANTS

START = pd.Timestamp("2023-01-01")


def raw_rows(n=24, state="06", county="037", site="0001", code="88101", poc=1, values=None, start=START):
    hours = [start + pd.Timedelta(hours=i) for i in range(n)]
    values = [float(i + 1) for i in range(n)] if values is None else values
    return [
        (state, county, site, code, poc, 34.05, -118.25, "California", "Los Angeles",
         h.strftime("%Y-%m-%d"), h.strftime("%H:%M"), v)
        for h, v in zip(hours, values)
    ]


RAW = (
    "state_code string, county_code string, site_number string, parameter_code string, poc int, latitude double, "
    "longitude double, state string, county string, date_gmt string, time_gmt string, sample_measurement double"
)


def raw_table(spark, rows=None):
    return spark.createDataFrame(raw_rows() if rows is None else rows, RAW)


def series(n, seed, gaps=0.0, scale=5.0, level=20.0):
    rng = np.random.default_rng(seed)
    values = level + rng.normal(0, scale, n)
    values[rng.random(n) < gaps] = np.nan
    return values


def clean_frame(n=400, station="060371103", seed=0, **columns):
    """A clean hourly table as pandas; keyword arrays replace the value columns."""
    frame = pd.DataFrame({
        "station_id": station, "timestamp_utc": pd.date_range(START, periods=n, freq="h"),
        "pm25": series(n, seed, level=10, scale=1), "no2": series(n, seed + 1, level=15, scale=2),
        "ozone": series(n, seed + 2, level=0.04, scale=0.005),
        "latitude": 34.05, "longitude": -118.25, "state": "California", "county": "Los Angeles",
    })
    for p in POLLUTANTS:
        for flag in ("interp", "drift", "neg", "bounds"):
            frame[f"{p}_{flag}_flag"] = False
    for name, values in columns.items():
        frame[name] = values
    return frame


def to_spark(spark, frame):
    """NaN becomes null."""
    schema = []
    for name, kind in frame.dtypes.items():
        text = str(kind)
        schema.append(f"{name} " + (
            "timestamp" if "datetime" in text else "double" if "float" in text else "boolean" if text == "bool"
            else "bigint" if "int" in text else "string"))
    rows = [
        tuple(None if v is None or (isinstance(v, float) and np.isnan(v)) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in row)
        for row in frame.astype(object).itertuples(index=False, name=None)
    ]
    return spark.createDataFrame(rows, ", ".join(schema))


def pulled(df, by=("station_id", "timestamp_utc")):
    return df.toPandas().sort_values(list(by)).reset_index(drop=True)
