"""Daily, monthly and annual summaries and flat forms of nested results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid import schemas
from hourgrid.functions import scalar as S
from hourgrid.operators import quality

PLACE = ("state", "county", "latitude", "longitude")


def _rounded(column: Column, digits: int | None) -> Column:
    return S.round_even(column, digits) if digits is not None else column


def daily_station(clean: DataFrame, digits: int | None = 4) -> DataFrame:
    """Daily means per station; days without any reading are left out.

    Metadata is constant per station in the clean table, so it is part of the grouping key.
    """
    means = [F.avg(p).alias(f"{p}_mean") for p in C.POLLUTANTS]
    any_mean = reduce(lambda a, b: a | b, (F.col(f"{p}_mean").isNotNull() for p in C.POLLUTANTS))
    days = clean.groupBy("station_id", F.to_date("timestamp_utc").alias("_day"), *PLACE).agg(*means)
    return days.filter(any_mean).select(
        "station_id", F.date_format("_day", "yyyy-MM-dd").alias("date"), *PLACE,
        F.month("_day").alias("month"), S.season_meteo(F.month("_day")).alias("season"),
        *(_rounded(F.col(f"{p}_mean"), digits).alias(f"{p}_mean") for p in C.POLLUTANTS),
    )


def monthly_state(clean: DataFrame, digits: int | None = 4) -> DataFrame:
    """Monthly means and active stations per state: sums per station and month, then per state."""
    month = F.date_format("timestamp_utc", "yyyy-MM").alias("year_month")
    stations = clean.filter(F.col("state").isNotNull()).groupBy("state", month, "station_id").agg(
        *(F.sum(p).alias(f"_s_{p}") for p in C.POLLUTANTS),
        *(F.count(p).alias(f"_n_{p}") for p in C.POLLUTANTS),
    )
    states = stations.groupBy("state", "year_month").agg(
        *(F.try_divide(F.sum(f"_s_{p}"), F.sum(f"_n_{p}")).alias(f"{p}_mean") for p in C.POLLUTANTS),
        *(F.count_if(F.col(f"_n_{p}") > 0).alias(f"stations_{p}") for p in C.POLLUTANTS),
    )
    number = F.substring("year_month", -2, 2).cast("int")
    return states.select(
        "state", "year_month", number.alias("month"), S.season_meteo(number).alias("season"),
        *(_rounded(F.col(f"{p}_mean"), digits).alias(f"{p}_mean") for p in C.POLLUTANTS),
        *(f"stations_{p}" for p in C.POLLUTANTS),
    )


def station_annual(clean: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean of all hours per station with its band, taken from the unrounded mean."""
    means = clean.groupBy("station_id", *PLACE).agg(*(F.avg(p).alias(f"avg_{p}") for p in C.POLLUTANTS))
    return means.select(
        "station_id", *PLACE,
        *(_rounded(F.col(f"avg_{p}"), digits).alias(f"avg_{p}") for p in C.POLLUTANTS),
        *(S.category(F.col(f"avg_{p}"), p).alias(f"aqi_cat_{p}") for p in C.POLLUTANTS),
    )


def category_distribution(annual: DataFrame) -> DataFrame:
    """Stations per band and pollutant with the band's position; empty bands are left out."""
    rank = S.choose(F.col("category"), {label: i for i, label in enumerate(C.CATEGORY_ORDER)})
    return annual.select(
        quality.per_pollutant({p: {"category": F.col(f"aqi_cat_{p}")} for p in C.POLLUTANTS})
    ).groupBy("pollutant", "category").agg(F.count(F.lit(1)).alias("stations")).withColumn("position", rank)


def flatten_metrics(documents: DataFrame, column: str = "document") -> DataFrame:
    """``{pollutant: {model: metrics}}`` to one row per pollutant and model."""
    tree = documents.select(F.explode(F.from_json(column, schemas.METRICS_TREE)).alias("pollutant", "_models"))
    return tree.select("pollutant", F.explode("_models").alias("model", "_m")).select("pollutant", "model", "_m.*")


def flatten_audit_states(documents: DataFrame, column: str = "document") -> DataFrame:
    tree = documents.select(F.explode(F.from_json(column, schemas.AUDIT_TREE)).alias("pollutant", "_a"))
    rows = tree.select("pollutant", F.explode("_a.by_state").alias("state", "_m"))
    return rows.select(
        "pollutant", "state", "_m.region", "_m.mae", "_m.rmse", "_m.r2", "_m.n_test", "_m.n_stations",
        F.coalesce("_m.flagged", F.lit(False)).alias("flagged"),
    )


def flatten_audit_regions(documents: DataFrame, column: str = "document") -> DataFrame:
    tree = documents.select(F.explode(F.from_json(column, schemas.AUDIT_TREE)).alias("pollutant", "_a"))
    rows = tree.select("pollutant", F.explode("_a.by_region").alias("region", "_m"))
    return rows.select(
        "pollutant", "region", F.array_join("_m.states", ", ").alias("states"),
        "_m.mae", "_m.rmse", "_m.r2", "_m.n_test", "_m.n_stations",
    )


def model_comparison(metrics: DataFrame, models: Sequence[str] = C.MODEL_NAMES) -> DataFrame:
    """Models side by side, one row per pollutant."""
    cells = [
        F.max(F.when(F.col("model") == m, F.col(k))).alias(f"{m}_{k}")
        for m in models for k in ("mae", "rmse", "r2")
    ]
    return metrics.groupBy("pollutant").agg(*cells)


def metrics_overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """New metrics replace old ones of the same pollutant and model as a whole; the rest is kept."""
    keys, fields = ["pollutant", "model"], ("mae", "rmse", "r2", "n_test")
    a = old.select(*keys, F.struct(*fields).alias("_old"))
    b = new.select(*keys, F.struct(*fields).alias("_new"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_new", "_old").alias("_m")).select(*keys, "_m.*")


def ablation(base: DataFrame, augmented: DataFrame) -> DataFrame:
    """Baseline against augmented metrics per pollutant: deltas, arrows and verdict."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("pollutant", *(F.col(k).alias(f"{name}_{k}") for k in ("mae", "rmse", "r2")))

    joined = side(base, "base").join(side(augmented, "aug"), "pollutant", "left")
    deltas = [
        F.round(F.col(f"aug_{k}") - F.col(f"base_{k}"), 4).alias(f"delta_{k}") for k in ("mae", "rmse", "r2")
    ]
    return joined.select(
        "*", *deltas, S.delta_text(F.col("base_mae"), F.col("aug_mae")).alias("delta_text"),
        S.verdict(F.col("base_mae"), F.col("aug_mae")).alias("verdict"),
    )


STAGES = ("load", "clean", "features", "train", "total")


def run_stats(runs: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """Mean and population deviation of each stage per path."""
    long = runs.select("path", F.inline(F.array(*(
        F.struct(F.lit(s).alias("stage"), F.col(s).alias("seconds")) for s in stages
    ))))
    return long.groupBy("path", "stage").agg(
        F.round(F.avg("seconds"), 3).alias("mean_s"), F.round(F.stddev_pop("seconds"), 3).alias("stdev_s"),
        F.count("seconds").alias("runs"),
    )


def run_savings(stats: DataFrame, slow: str, fast: str) -> DataFrame:
    """Seconds and share saved per stage by the fast path."""
    both = stats.groupBy("stage").agg(
        F.max(F.when(F.col("path") == slow, F.col("mean_s"))).alias("slow_s"),
        F.max(F.when(F.col("path") == fast, F.col("mean_s"))).alias("fast_s"),
    )
    return both.select(
        "*", F.round(F.col("slow_s") - F.col("fast_s"), 3).alias("saved_s"),
        F.round((1 - F.try_divide(F.col("fast_s"), F.col("slow_s"))) * 100, 1).alias("reduction_pct"),
    )


def bundle_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Position, name, row count and column list of each table of a bundle, in the given order."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("position"), F.lit(name).alias("name"), "rows",
            F.lit(", ".join(table.columns)).alias("columns"),
        )
        for i, (name, table) in enumerate(tables.items(), 1)
    ]
    return reduce(DataFrame.unionByName, parts)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sorted_output(df: DataFrame, by: Sequence[str] = ("station_id", "timestamp_utc")) -> DataFrame:
    """Range partitions, each sorted: a global order over the written files without one big sort task."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)
