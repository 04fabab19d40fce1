"""ARIMA(2, 1, 2) for every station and pollutant at once, by the two regressions of Hannan and Rissanen.

Both regressions are sums of products over lagged differences, so Spark reduces each series to a few
dozen numbers wherever its rows lie; only those numbers reach the small solver. First a long
autoregression estimates the shocks, then the differences are regressed on two lags of themselves and
two lags of the shocks. The forecast is one recursion from the end of the training span.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid import constants as C
from hourgrid.operators import evaluate, features, quality
from hourgrid.operators import timeblocks as B

# Order and the least history and test length of a series.
ORDER = (2, 1, 2)
MIN_TRAIN_ROWS = 500
MIN_TEST_ROWS = 24
LONG_LAGS = 8
SERIES = ("station_id", "pollutant")


def long_series(clean: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS) -> DataFrame:
    """One row per station, pollutant and hour, whether the station measures the pollutant or not."""
    return clean.select("station_id", "timestamp_utc", quality.per_pollutant({p: {"value": F.col(p)} for p in pollutants}))


def _history(train: DataFrame) -> DataFrame:
    """Differences of each hour and the hours before it, newest first, as ``d`` (full rows only).

    Rows stay where their block's windows put them: by series and ``_block``.
    """
    depth = LONG_LAGS + max(ORDER[0], ORDER[2])
    rows = B.spread(train)
    part = "partition by station_id, pollutant, _block order by _hour"
    lagged = rows.selectExpr("*", f"value - lag(value) over ({part}) as _d")
    gathered = lagged.selectExpr(
        "*", f"collect_list(_d) over ({part} rows between {depth} preceding and current row) as _list"
    )
    owned = gathered.filter(f"_block = floor(_hour / {B.BLOCK_HOURS})")
    return owned.filter(F.size("_list") == depth + 1).select(
        *SERIES, "_block", "timestamp_utc", "value", F.reverse("_list").alias("d")
    )


def _gram(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Upper triangle of the products of ``terms`` summed per block; the first term is the response."""
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    return rows.groupBy(*SERIES, "_block").agg(F.count(F.lit(1)).alias("rows"), F.array(*(
        F.sum(F.expr(f"({terms[i]}) * ({terms[j]})")) for i, j in pairs
    )).alias("sums"))


def _merged(blocks: DataFrame, terms: int) -> DataFrame:
    """Sums of a series from those of its blocks."""
    return blocks.groupBy(*SERIES).agg(F.sum("rows").alias("rows"), F.array(*(
        F.sum(F.col("sums")[k]) for k in range(terms * (terms + 1) // 2)
    )).alias("sums"))


def _solve(sums: np.ndarray) -> np.ndarray:
    """Least squares from summed products of the response and its regressors."""
    size = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = sums
    full += np.triu(full, 1).T
    return np.linalg.lstsq(full[1:, 1:], full[1:, 0], rcond=None)[0]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_series(sums: pd.Series) -> pd.Series:
    return sums.map(lambda s: _solve(np.asarray(s, dtype=float)))


def _shock(lag: int) -> str:
    """Residual of the long autoregression some hours back."""
    return f"d[{lag}] - (" + " + ".join(f"a[{k}] * d[{lag + k + 1}]" for k in range(LONG_LAGS)) + ")"


def _long_regression(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums per block, and per series the merged sums with the long autoregression's coefficients ``a``."""
    blocks = _gram(history, [f"d[{k}]" for k in range(LONG_LAGS + 1)])
    return blocks, _merged(blocks, LONG_LAGS + 1).withColumn("a", solve_series("sums"))


def long_regression(train: DataFrame) -> DataFrame:
    """Per series: number of full rows, summed products (``sums``) and long autoregression (``a``)."""
    return _long_regression(_history(train))[1]


def coefficients(train: DataFrame) -> DataFrame:
    """Per series: two autoregressive and two shock coefficients, ``stationary``, and the state at the last hour.

    Coefficients of the long regression go to each block of their series, so the history meets them by series and
    block, where it already lies; no series gathers in one task.
    """
    history = _history(train)
    blocks, long = _long_regression(history)
    marks = blocks.select(*SERIES, "_block").join(long.select(*SERIES, "a"), list(SERIES))
    shocked = history.join(marks.hint("merge"), [*SERIES, "_block"]).selectExpr(
        *SERIES, "_block", "timestamp_utc", "value", "d", *(f"{_shock(k)} as e{k}" for k in range(3))
    )
    terms = ["d[0]", "d[1]", "d[2]", "e1", "e2"]
    short = _merged(_gram(shocked, terms), len(terms)).select(*SERIES, solve_series("sums").alias("c"))
    ends = shocked.groupBy(*SERIES).agg(F.max_by(
        F.struct("value", "d", "e0", "e1", "timestamp_utc"), "timestamp_utc").alias("end"))
    return short.join(ends, list(SERIES)).selectExpr(
        *SERIES, "c as coefficients", "abs(c[1]) < 1 and abs(c[0]) < 1 - c[1] as stationary",
        "end.timestamp_utc as last_hour", "array(end.value, end.d[0], end.d[1], end.e0, end.e1) as state",
    )


def stable_pair(a: float, b: float, radius: float = 0.99) -> tuple[float, float]:
    """Shrink an explosive pair of autoregressive coefficients to a decaying one."""
    largest = max(abs(np.roots([1.0, -a, -b])), default=0.0)
    if largest <= radius:
        return a, b
    shrink = radius / largest
    return a * shrink, b * shrink * shrink


FORECAST = "station_id string, pollutant string, timestamp_utc timestamp, y_pred double, stationary boolean"


#: Series whose recursions run side by side.
SIDE_BY_SIDE = 256


def _recursions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per series in, one row per forecast hour out."""
    for frame in frames:
        for start in range(0, len(frame), SIDE_BY_SIDE):
            part = frame.iloc[start:start + SIDE_BY_SIDE]
            phi1, phi2, theta1, theta2 = np.stack(part["coefficients"].to_numpy()).astype(float).T
            level, d1, d2, e1, e2 = np.stack(part["state"].to_numpy()).astype(float).T
            steps = part["steps"].to_numpy(np.int64)
            out = np.empty((len(part), steps.max()))
            # What explodes is let explode, up to infinity.
            with np.errstate(over="ignore", invalid="ignore"):
                for i in range(out.shape[1]):
                    step = phi1 * d1 + phi2 * d2 + theta1 * e1 + theta2 * e2
                    d1, d2, e1, e2 = step, d1, np.zeros(len(part)), e1
                    level = level + step
                    out[:, i] = level
            row, hour = np.nonzero(np.arange(out.shape[1]) < steps[:, None])
            known = part.iloc[row].reset_index(drop=True)
            yield pd.DataFrame({
                "station_id": known["station_id"], "pollutant": known["pollutant"],
                "timestamp_utc": known["last_hour"] + pd.to_timedelta(hour + 1, unit="h"), "y_pred": out[row, hour],
                "stationary": known["stationary"],
            })


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _damped(coefficients: pd.Series) -> pd.Series:
    return coefficients.map(lambda c: [*stable_pair(c[0], c[1]), c[2], c[3]])


def training_rows(clean: DataFrame, cutoffs: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS) -> DataFrame:
    """Filled rows before the cutoff of the series that have a reading there."""
    # At most one cutoff per pollutant.
    rows = long_series(clean, pollutants).join(F.broadcast(cutoffs), "pollutant").filter("timestamp_utc < cutoff")
    filled = features.fill_both_ways(rows.select(*SERIES, "timestamp_utc", "value"), "value", SERIES)
    # Filled both ways, a series has a value everywhere or nowhere.
    return filled.filter("value is not null")


def fitted_series(
    clean: DataFrame, cutoffs: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS, damp: bool = False,
) -> DataFrame:
    """``coefficients`` of every series with enough history, and the ``steps`` of its test span.

    ``stationary`` says whether the estimate decays. It is used as it is, unless ``damp`` asks for explosive pairs
    to be shrunk to decaying ones.
    """
    before = F.col("timestamp_utc") < F.col("cutoff")
    sizes = long_series(clean, pollutants).join(F.broadcast(cutoffs), "pollutant").groupBy(*SERIES).agg(
        F.count_if(before).alias("_train"), F.count_if(~before).alias("steps"),
    ).filter(f"_train >= {MIN_TRAIN_ROWS} and steps >= {MIN_TEST_ROWS}")
    fitted = coefficients(training_rows(clean, cutoffs, pollutants)).join(
        sizes.select(*SERIES, "steps"), list(SERIES))
    return fitted.withColumn("coefficients", _damped("coefficients")) if damp else fitted


def station_forecasts(
    clean: DataFrame, cutoffs: DataFrame, pollutants: Sequence[str] = C.POLLUTANTS, damp: bool = False,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """Forecast of the whole test span of every series with enough history, next to the readings.

    ``fitted`` is the result of ``fitted_series`` for the same tables, where the caller has it already.
    """
    if fitted is None:
        fitted = fitted_series(clean, cutoffs, pollutants, damp)
    # A row per series, each of which becomes a whole test span: few bytes, which must not be merged into one task.
    parts = int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forecast = fitted.repartition(parts, *SERIES).mapInPandas(_recursions, FORECAST)
    actual = long_series(clean, pollutants).join(F.broadcast(cutoffs), "pollutant").filter(
        "timestamp_utc >= cutoff").select(*SERIES, "timestamp_utc", F.col("value").alias("y_true"))
    return forecast.join(actual, [*SERIES, "timestamp_utc"], "left")


def arima_metrics(forecasts: DataFrame) -> DataFrame:
    return evaluate.regression_metrics(forecasts, (*SERIES, "stationary")).withColumn("model", F.lit("ARIMA"))
