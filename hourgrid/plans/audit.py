"""Geographic audit of stored predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.operators import evaluate


def group_report(predictions: DataFrame, places: DataFrame, ratio: float = C.FLAG_RATIO) -> DataFrame:
    """Metrics overall, per state and per region with flags and positions; ``position`` is 0 overall."""
    groups = evaluate.metrics_by_group(evaluate.geo_join(predictions, places))
    flagged = evaluate.flag_groups(groups, ratio)
    order = Window.partitionBy("pollutant", "level").orderBy(F.asc_nulls_last("mae"), "name")
    position = F.when(F.col("level") == "overall", F.lit(0)).otherwise(F.row_number().over(order))
    return flagged.withColumn("position", position)


def audit_document(report: DataFrame) -> DataFrame:
    """The report as one JSON document ``{pollutant: {overall, by_state, by_region}}``.

    The report has one row per state or region and pollutant, so one row can hold it.
    """
    metric = ("mae", "rmse", "r2", "n_test")

    def level(name: str, *fields: str):
        entry = F.struct("name", F.struct(*metric, *fields).alias("m"))
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("level") == name, entry))))

    trees = report.groupBy("pollutant").agg(
        F.first(F.when(F.col("level") == "overall", F.struct(*metric)), ignorenulls=True).alias("overall"),
        level("state", "region", "n_stations", "flagged").alias("by_state"),
        level("region", "n_stations", "states").alias("by_region"),
    )
    tree = F.struct("overall", "by_state", "by_region")
    return trees.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("pollutant", tree.alias("t"))))).alias("document"))
