"""Headline timings as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The stages are those of a full retrain
(load, clean, features, train) and of a retrain from stored features, each timed to its written result,
and some single reports. One untimed pass over the cleaning step warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402
from catalog import adapter as A  # noqa: E402
from hourgrid.operators import cleaning, evaluate, features, weather  # noqa: E402
from hourgrid.plans import training  # noqa: E402
from hourgrid.plans.staging import staged  # noqa: E402
from hourgrid.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Published times of the same steps, in seconds.
BASELINE = {"full_retrain": 22.071, "cached_retrain": 15.279}
REPORTS = ("daily_station", "monthly_state", "cleaning_report", "live_features", "stream_hourly_mean")


def main() -> None:
    spark = get_session(
        "bench", f"local[{CPUS}]", **{
            "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
            # The tables are small here and the windows are computation, so small partitions stay apart.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, step):
        start = time.perf_counter()
        out = step()
        times[name] = round(time.perf_counter() - start, 3)
        return out

    def clean():
        return staged(cleaning.clean_hourly(raw), "clean")

    raw = A.raw_long(spark, SF_DIR).drop("event_id")
    clean()
    raw = timed("load", lambda: staged(A.raw_long(spark, SF_DIR).drop("event_id"), "raw"))
    hours = timed("clean", clean)
    joined = timed("weather_join", lambda: staged(weather.join_weather(hours, A.weather(spark, SF_DIR)), "joined"))
    table = timed("features", lambda: staged(features.build_features(joined), "features"))

    def train():
        train_side, _, _ = evaluate.time_split(table)
        return training.train_all(train_side, ("GradientBoosting",))

    # Training reads the stored feature table, so its time is that of a retrain from stored features.
    timed("cached_retrain", train)
    times["full_retrain"] = round(sum(times[k] for k in ("load", "clean", "features", "cached_retrain")), 3)
    for name in REPORTS:
        timed(name, lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(v for k, v in times.items() if k != "full_retrain"), 3)
    print(json.dumps({
        "metric": "total_wall_clock", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "ratio_to_baseline": {k: round(times[k] / v, 2) for k, v in BASELINE.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
