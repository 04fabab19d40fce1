"""Streams of measurements to hourly means, rolling statistics, live features and scores.

A measurement stream has ``station_id, pollutant, timestamp_utc, value``. Every job runs as an
``availableNow`` or a continuous query with a checkpoint; nothing here depends on how often it is triggered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import requests as R
from hourgrid.plans.scoring import Models, apply_models
from hourgrid.plans.staging import staged

WATERMARK = "2 hours"


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly_means(measurements: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling one-hour means; readings later than the watermark are dropped."""
    return (
        measurements.withWatermark("timestamp_utc", watermark)
        .groupBy(F.window("timestamp_utc", "1 hour"), "station_id", "pollutant")
        .agg(F.avg("value").alias("value"), F.count("value").alias("readings"))
        .select("station_id", "pollutant", F.col("window.start").alias("timestamp_utc"), "value", "readings")
    )


# -- Series state: a row a day ---------------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROLLING_SCHEMA = "station_id string, pollutant string, timestamp_utc timestamp, mean double, std double, hours long"
LIVE_SCHEMA = (
    "station_id string, pollutant string, timestamp_utc timestamp, lag_1h double, lag_24h double, lag_168h double, "
    "roll_24h_mean double, roll_24h_std double, roll_168h_mean double, roll_168h_std double"
)
HOUR, HOUR_MS, DAY = 3600, 3_600_000, 24
#: Days of a series that a worker holds at once, enough for a week's span and the day being written.
HELD_DAYS = 12


class DayState:
    """Hourly values of one series in map state, a row of 24 a day, of which at most ``HELD_DAYS`` are in memory."""

    def __init__(self, handle: StatefulProcessorHandle):
        self._rows = handle.getMapState("days", "day long", "hours array<double>, waiting long")
        self._held: dict[int, list] = {}

    def forget_held(self) -> None:
        """Write what is held and start with another series."""
        for day in list(self._held):
            self._put(day)

    def _put(self, day: int) -> None:
        values, waiting, changed = self._held.pop(day)
        if changed:
            self._rows.updateValue((day,), ([None if v != v else float(v) for v in values], waiting))

    def _day(self, day: int) -> list:
        """[24 values, bits of the hours that wait to be emitted, whether it must be written]."""
        if day in self._held:
            self._held[day] = self._held.pop(day)
        else:
            if len(self._held) >= HELD_DAYS:
                self._put(next(iter(self._held)))
            stored = self._rows.getValue((day,)) if self._rows.containsKey((day,)) else None
            values = np.full(DAY, np.nan) if stored is None else np.array([np.nan if v is None else v for v in stored[0]])
            self._held[day] = [values, 0 if stored is None else stored[1], False]
        return self._held[day]

    def put(self, hour: int, value: float) -> bool:
        """Store an hour's value, the later one of two; whether the hour is new."""
        row = self._day(hour // DAY)
        new = not row[1] >> 32 + hour % DAY & 1
        row[0][hour % DAY] = np.nan if value is None else value
        row[1] |= 1 << 32 + hour % DAY | (1 << hour % DAY if new else 0)
        row[2] = True
        return new

    def waiting(self, day: int) -> list[int]:
        """Hours of a day that have not been emitted."""
        bits = self._day(day)[1]
        return [day * DAY + k for k in range(DAY) if bits >> k & 1]

    def emitted(self, hour: int) -> None:
        row = self._day(hour // DAY)
        row[1] &= ~(1 << hour % DAY)
        row[2] = True

    def get(self, hour: int) -> float:
        return self._day(hour // DAY)[0][hour % DAY]

    def hours(self, start: int, end: int) -> np.ndarray:
        """Values of the hours ``start`` to ``end``, the last one excluded; NaN where none is known."""
        first = start // DAY
        rows = np.concatenate([self._day(d)[0] for d in range(first, (end - 1) // DAY + 1)])
        return rows[start - first * DAY:end - first * DAY]

    def span(self, start: int, end: int) -> np.ndarray:
        """Known values of the hours ``start`` to ``end``, the last one excluded."""
        inside = self.hours(start, end)
        return inside[~np.isnan(inside)]

    def drop(self, day: int) -> None:
        self._held.pop(day, None)
        if self._rows.containsKey((day,)):
            self._rows.removeKey((day,))


class _SeriesProcessor(StatefulProcessor):
    """Rows of a series come in, its state advances to the watermark, and a timer calls again for what waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.days = handle, DayState(handle)
        # The oldest day kept, the position (what it means is up to the subclass), the newest hour, the timer set.
        self.mark = handle.getValueState("mark", "floor long, at long, top long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        floor, at, top, timer = self.mark.get() if self.mark.exists() else (None, None, None, None)
        for frame in rows:
            seconds = frame["timestamp_utc"].astype("datetime64[s]").astype("int64")
            known = sorted(zip((seconds // HOUR).tolist(), range(len(frame)), frame["value"].tolist(), strict=True))
            for hour, _, value in known:
                if self.days.put(hour, value):
                    at = self.arrived(at, hour)
                floor = hour // DAY if floor is None else min(floor, hour // DAY)
                top = hour if top is None else max(top, hour)
        yield from self._advance(key, floor, at, top, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.mark.exists():
            floor, at, top, _ = self.mark.get()
            yield from self._advance(key, floor, at, top, None, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, floor, at, top, timer, watermark):
        out = []
        state = [at]
        for row in self.ready(state, top, watermark):
            out.append((*key, *row))
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=self.columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.columns)
        at = state[0]
        keep = (watermark // HOUR_MS - self.history) // DAY
        while floor < keep and floor * DAY <= top:
            if not self.days.waiting(floor):
                self.days.drop(floor)
            floor += 1
        if timer is not None:
            self.handle.deleteTimer(timer)
        if floor * DAY > top:
            self.days.forget_held()
            self.mark.clear()
            return
        due = self.due(at, top)
        due = max((top + self.history + DAY + 1) * HOUR_MS if due is None else due, watermark + 1)
        self.handle.registerTimer(due)
        self.mark.update((floor, at, top, due))
        self.days.forget_held()

    def close(self) -> None:
        pass


class _Rolling(_SeriesProcessor):
    """Means and deviations of the last hours for every hour up to the watermark; the position is the next hour."""

    columns = ["station_id", "pollutant", "timestamp_utc", "mean", "std", "hours"]

    def __init__(self, width: int):
        self.width, self.history = width, width

    def arrived(self, at, hour):
        return hour + 1 if at is None else min(at, hour + 1)

    def ready(self, state, top, watermark):
        last = min(watermark // HOUR_MS, top + self.width)
        # Up to a day's hours at once, whose spans share their values.
        for t in range(state[0], last + 1, DAY):
            end = min(t + DAY, last + 1)
            spans = np.lib.stride_tricks.sliding_window_view(self.days.hours(t - self.width, end - 1), self.width)
            known = ~np.isnan(spans)
            n = known.sum(axis=1)
            mean = np.where(known, spans, 0.0).sum(axis=1) / np.maximum(n, 1)
            off = np.where(known, spans - mean[:, None], 0.0)
            std = np.sqrt((off * off).sum(axis=1) / np.maximum(n, 1))
            for k in np.flatnonzero(n >= 2).tolist():
                yield pd.Timestamp((t + k) * HOUR, unit="s"), float(mean[k]), float(std[k]), int(n[k])
        state[0] = max(state[0], last + 1)

    def due(self, at, top):
        return at * HOUR_MS - 1 if at <= top + self.width else None


class _Live(_SeriesProcessor):
    """Reading features of each hour that arrives; the position is the earliest day with an hour not emitted.

    Spark's watermark runs ``late`` hours behind the newest hour and only drops what is older; the features
    follow a nearer one, ``wait`` hours behind.
    """

    columns = ["station_id", "pollutant", "timestamp_utc", "lag_1h", "lag_24h", "lag_168h",
               "roll_24h_mean", "roll_24h_std", "roll_168h_mean", "roll_168h_std"]
    history = C.HISTORY_HOURS

    def __init__(self, wait: int, late: int):
        self.shift = (late - wait) * HOUR_MS

    def arrived(self, at, hour):
        return hour // DAY if at is None else min(at, hour // DAY)

    def features(self, hour):
        lags = (self.days.get(hour - back) for back in (1, 24, 168))
        out = [None if v != v else float(v) for v in lags]
        for width in (24, 168):
            inside = self.days.span(hour - width, hour)
            out += [float(inside.mean()), float(inside.std())] if len(inside) >= 2 else [None, None]
        return out

    def ready(self, state, top, watermark):
        last = (watermark + self.shift) // HOUR_MS
        while state[0] is not None:
            hours = self.days.waiting(state[0])
            for hour in hours:
                if hour > last:
                    return
                yield pd.Timestamp(hour * HOUR, unit="s"), *self.features(hour)
                self.days.emitted(hour)
            state[0] = state[0] + 1 if (state[0] + 1) * DAY <= top else None

    def due(self, at, top):
        waiting = [] if at is None else self.days.waiting(at)
        return waiting[0] * HOUR_MS - 1 - self.shift if waiting else None


def _stateful(hourly: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    """State in maps and with timers needs the RocksDB store, which spills to disk and is saved with the checkpoint."""
    hourly.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return hourly.groupBy("station_id", "pollutant").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def rolling_means(measurements: DataFrame, hours: int = 24, watermark: str = WATERMARK) -> DataFrame:
    """Mean and population deviation of the hourly means over ``[t - hours, t)``, hop one hour.

    The end of the span is ``t``, so the hour ``t`` itself is left out. Two means are required. The state of a
    series is a row for each day of the span; each hourly mean is stored once, whatever the width.
    """
    hourly = (
        measurements.withWatermark("timestamp_utc", watermark)
        .groupBy(F.window("timestamp_utc", "1 hour"), "station_id", "pollutant")
        .agg(F.avg("value").alias("value"))
        .select("station_id", "pollutant", F.window_time("window").alias("timestamp_utc"), "value")
    )
    return _stateful(hourly, _Rolling(hours), ROLLING_SCHEMA)


def live_features(hourly: DataFrame, wait: int = 0, late: int = 30 * 24) -> DataFrame:
    """Reading features of every hour from a stream of hourly means.

    An hour is emitted once the newest hour of the stream is ``wait`` hours ahead of it, in order; give as much
    as hours can be out of order between triggers. One that comes later than that is emitted at once, with the
    history that has arrived. Only hours more than ``late`` hours behind the newest are dropped. A second value
    of an hour replaces the first in the history and is not emitted again. The state of a series holds
    ``late`` hours and a week in rows of a day, and is forgotten without news for that long; a worker has a
    few days in memory, however many a trigger brings.
    """
    if not 0 <= wait <= late:
        raise ValueError("wait must lie between 0 and late")
    marked = hourly.select("station_id", "pollutant", "timestamp_utc", "value").withWatermark("timestamp_utc", f"{late} hours")
    return _stateful(marked, _Live(wait, late), LIVE_SCHEMA)


def complete_features(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Calendar, place and provenance for streamed reading features; stateless, so it suits any batch."""
    located = rows.join(places.select("station_id", "latitude", "longitude"), "station_id", "left")
    filled = located.withColumns({
        **S.calendar_features(F.col("timestamp_utc")), "drift_flag": F.lit(0.0),
        **{c: F.lit(None).cast("double") for c in C.WEATHER_COLUMNS}, "weather_error": F.lit("no weather in the stream"),
    })
    from hourgrid.operators.live import provenance

    return filled.withColumn("feature_provenance", provenance()).drop("weather_error")


# -- Sinks ---------------------------------------------------------------------------------------

def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a parquet table, each row once."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def to_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Write ``transform`` of every micro-batch to its own folder; a repeated batch replaces it.

    The batch is stored first, in a folder readers of ``path`` pass over: a transform may read it several times,
    and each time would run the stateful operator again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(staged(batch, "batch", f"{path}/_incoming")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def scored(batch: DataFrame, places: DataFrame, models: Models) -> DataFrame:
    """Complete, guard, score and clip a batch of streamed features."""
    rows = complete_features(batch, places).withColumn("model", F.lit(C.REQUEST_MODELS[0]))
    ready, _ = R.essential_lag_guard(rows)
    return apply_models(ready, models).select(
        "station_id", "pollutant", "timestamp_utc", R.target_time(F.col("timestamp_utc")).alias("target_time"),
        "prediction", "feature_provenance",
    )


def run(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` query."""
    query.awaitTermination()
