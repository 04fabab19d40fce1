"""Time split, error metrics, geographic audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.functions.significance import correlation_p_value


# -- Split ---------------------------------------------------------------------------------------

def split_cutoffs(features: DataFrame, test_fraction: float = C.TEST_FRACTION) -> DataFrame:
    """Per pollutant the timestamp at sorted position ``int(n * (1 - test_fraction))``.

    Exact, without sorting rows: a histogram of hours, then a running count over it.
    """
    hours = features.groupBy("pollutant", "timestamp_utc").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy("pollutant").orderBy("timestamp_utc")
    counted = hours.select(
        "pollutant", "timestamp_utc",
        F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"),
        F.sum("_n").over(Window.partitionBy("pollutant")).alias("_total"),
    )
    position = F.floor(F.col("_total") * F.lit(1 - test_fraction))
    return counted.filter(F.col("_upto") > position).groupBy("pollutant").agg(
        F.min("timestamp_utc").alias("cutoff")
    )


def time_split(
    features: DataFrame, test_fraction: float = C.TEST_FRACTION, embargo_hours: int = 0, cutoffs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train before the cutoff (less an optional embargo), test from it on, and the cutoffs.

    Hand in stored ``cutoffs`` where the sides are read several times; else each reading finds them again.
    """
    cutoffs = split_cutoffs(features, test_fraction) if cutoffs is None else cutoffs
    # At most one row per pollutant.
    joined = features.join(F.broadcast(cutoffs), "pollutant")
    ts, cutoff = F.col("timestamp_utc"), F.col("cutoff")
    train = joined.filter(ts < cutoff - F.expr(f"interval {int(embargo_hours)} hours")).drop("cutoff")
    return train, joined.filter(ts >= cutoff).drop("cutoff"), cutoffs


def persistence(features: DataFrame) -> DataFrame:
    """The value of a day before the row's hour as a deterministic forecast."""
    return features.select(
        "pollutant", "station_id", "timestamp_utc", F.col("target").alias("y_true"),
        F.col("lag_24h").alias("y_pred"),
    )


# -- Metrics -------------------------------------------------------------------------------------

def _finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def _paired(pred: DataFrame) -> DataFrame:
    return pred.filter(_finite(F.col("y_true")) & _finite(F.col("y_pred"))).withColumn(
        "_d", F.col("y_true") - F.col("y_pred")
    )


def _finish(n: Column, absolute: Column, squared: Column, total: Column, digits: int | None) -> list[Column]:
    """MAE, RMSE, R2 and n from sums; null metrics below two pairs."""
    r2 = F.when(total > 0, 1 - squared / total).when(squared == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    values = {"mae": F.try_divide(absolute, n), "rmse": F.sqrt(F.try_divide(squared, n)), "r2": r2}
    out = []
    for name, value in values.items():
        value = F.round(value, digits) if digits is not None else value
        out.append(F.when(n >= 2, value).alias(name))
    return [*out, F.coalesce(n, F.lit(0)).alias("n_test")]


def regression_metrics(pred: DataFrame, by: Sequence[str] = ("pollutant",), digits: int | None = 4) -> DataFrame:
    """MAE, RMSE, R2 and n over the rows where truth and prediction are both finite."""
    sums = _paired(pred).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs("_d")).alias("_a"),
        F.sum(F.col("_d") * F.col("_d")).alias("_s"),
        (F.var_pop("y_true") * F.count(F.lit(1))).alias("_t"),
    )
    return sums.select(*by, *_finish(F.col("_n"), F.col("_a"), F.col("_s"), F.col("_t"), digits))


def geo_join(pred: DataFrame, places: DataFrame) -> DataFrame:
    """State and region of each prediction's station; rows without a state are dropped."""
    return pred.join(places.select("station_id", "state", "region"), "station_id", "left").filter(
        F.col("state").isNotNull()
    )


def unmapped_count(pred: DataFrame, places: DataFrame) -> DataFrame:
    """Prediction rows per pollutant whose station has no state."""
    known = places.filter(F.col("state").isNotNull()).select("station_id")
    return pred.join(known, "station_id", "left_anti").groupBy("pollutant").agg(
        F.count(F.lit(1)).alias("unmapped_rows")
    )


def metrics_by_group(located: DataFrame, digits: int | None = 4) -> DataFrame:
    """Metrics overall, per state and per region, with station counts.

    Rows are reduced to one per station first; the grouping sets then run over stations only.
    Result: ``pollutant, level, name, region, states, mae, rmse, r2, n_test, n_stations``.
    """
    stations = _paired(located).groupBy("pollutant", "state", "region", "station_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs("_d")).alias("_a"),
        F.sum(F.col("_d") * F.col("_d")).alias("_s"), F.avg("y_true").alias("_m"),
        (F.var_pop("y_true") * F.count(F.lit(1))).alias("_t"),
    ).withColumns({"_state": F.col("state"), "_region": F.col("region")})
    p, s, r = F.col("pollutant"), F.col("state"), F.col("region")
    weighted = F.col("_n") * F.col("_m")
    between = F.sum(weighted * F.col("_m")) - F.sum(weighted) * F.sum(weighted) / F.sum("_n")
    grouped = stations.groupingSets([[p], [p, s], [p, r]], p, s, r).agg(
        F.grouping("state").alias("_no_state"), F.grouping("region").alias("_no_region"),
        F.sum("_n").alias("_n"), F.sum("_a").alias("_a"), F.sum("_s").alias("_s"),
        (F.sum("_t") + F.greatest(between, F.lit(0.0))).alias("_t"),
        F.count(F.lit(1)).alias("n_stations"), F.min("_region").alias("_home"),
        F.sort_array(F.collect_set("_state")).alias("_states"),
    )
    is_state, is_region = F.col("_no_state") == 0, F.col("_no_region") == 0
    return grouped.select(
        "pollutant",
        F.when(is_state, F.lit("state")).when(is_region, F.lit("region")).otherwise(F.lit("overall")).alias("level"),
        F.when(is_state, F.col("state")).when(is_region, F.col("region")).otherwise(F.lit("all")).alias("name"),
        F.when(is_state, F.col("_home")).when(is_region, F.col("region")).alias("region"),
        F.when(is_region, F.col("_states")).alias("states"),
        *_finish(F.col("_n"), F.col("_a"), F.col("_s"), F.col("_t"), digits), "n_stations",
    )


# The tables below have one row per state or region and pollutant; their windows stay that small.

def flag_groups(groups: DataFrame, ratio: float = C.FLAG_RATIO) -> DataFrame:
    """Mark states whose (rounded) MAE exceeds the overall MAE times ``ratio``."""
    overall = F.max(F.when(F.col("level") == "overall", F.col("mae"))).over(Window.partitionBy("pollutant"))
    flagged = (F.col("level") == "state") & (F.col("mae") > overall * ratio)
    return groups.withColumn("flagged", F.coalesce(flagged, F.lit(False)))


def rank_groups(groups: DataFrame) -> DataFrame:
    """Position of each state and region by MAE ascending, unknown MAE last."""
    order = Window.partitionBy("pollutant", "level").orderBy(F.asc_nulls_last("mae"), "name")
    return groups.filter(F.col("level") != "overall").withColumn("position", F.row_number().over(order))


def best_worst(groups: DataFrame) -> DataFrame:
    """Lowest and highest MAE per pollutant and level; the first name wins a tie on both ends."""
    known = groups.filter((F.col("level") != "overall") & F.col("mae").isNotNull())
    return known.groupBy("pollutant", "level").agg(
        F.min_by("name", F.struct("mae", "name")).alias("best"), F.min("mae").alias("best_mae"),
        F.min_by("name", F.struct(-F.col("mae"), F.col("name"))).alias("worst"),
        F.max("mae").alias("worst_mae"),
    ).withColumn("mae_ratio", F.round(F.try_divide(F.col("worst_mae"), F.col("best_mae")), 2))


def average_rank(column: str, by: Sequence[str]) -> Column:
    """Rank with ties sharing their mean position."""
    first = F.rank().over(Window.partitionBy(*by).orderBy(column))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    return first + (peers - 1) / 2


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ("pollutant",), min_n: int = 4) -> DataFrame:
    """Rank correlation with a two-sided p value; null below ``min_n`` rows or without spread."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.select(*by, average_rank(x, by).alias("_x"), average_rank(y, by).alias("_y"))
    # ``corr`` itself raises an error where a side has no spread.
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("_x", "_y"), spread).alias("_rho")
    )
    rho = F.when(F.col("n") >= min_n, F.col("_rho"))
    return sums.select(*by, "n", rho.alias("rho")).withColumn(
        "p_value", correlation_p_value(F.col("rho"), F.col("n").cast("double"))
    )


def disparity(groups: DataFrame, ratio: float = C.FLAG_RATIO) -> DataFrame:
    """One row per pollutant: best and worst state and region, flagged states, rank correlation."""
    flagged = flag_groups(groups, ratio)
    ends = best_worst(groups)
    fields = ("best", "best_mae", "worst", "worst_mae", "mae_ratio")
    sides = ends.groupBy("pollutant").agg(*(
        F.max(F.when(F.col("level") == level, F.col(f))).alias(f"{level}_{f}")
        for level in ("state", "region") for f in fields
    ))
    marks = flagged.groupBy("pollutant").agg(
        F.sort_array(F.collect_set(F.when(F.col("flagged"), F.col("name")))).alias("flagged_states")
    )
    states = groups.filter((F.col("level") == "state") & F.col("mae").isNotNull())
    ranks = spearman(states, "n_test", "mae").select(
        "pollutant", F.round("rho", 3).alias("rho"), F.round("p_value", 4).alias("p_value"),
        S.correlation_label(F.col("rho"), F.col("p_value")).alias("interpretation"),
    )
    # One row per pollutant on each side.
    return sides.join(F.broadcast(marks), "pollutant").join(F.broadcast(ranks), "pollutant", "left").withColumn(
        "flag_threshold_ratio", F.lit(float(ratio))
    )


def station_places(clean: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """State and region per station; ``regions(state, region)`` replaces the census regions."""
    places = clean.groupBy("station_id").agg(F.min("state").alias("state"))
    if regions is None:
        return places.withColumn("region", S.census_region(F.col("state")))
    return places.join(regions, "state", "left").select(
        "station_id", "state", F.coalesce("region", F.lit(C.UNKNOWN_REGION)).alias("region")
    )


def state_regions(places: DataFrame) -> DataFrame:
    """Distinct states with their region, in order."""
    return places.select("state", "region").dropDuplicates(["state", "region"]).orderBy("state", "region")


def unmapped_states(places: DataFrame) -> DataFrame:
    return places.filter(F.col("region") == C.UNKNOWN_REGION).select("state").distinct()
