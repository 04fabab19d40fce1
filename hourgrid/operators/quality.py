"""Row accounting, missingness and flag counts of the cleaning step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid import constants as C
from hourgrid.functions import scalar as S
from hourgrid.operators import cleaning


def per_pollutant(columns: dict[str, dict[str, Column]], name: str = "pollutant") -> Column:
    """Generator of one row per pollutant from ``{pollutant: {column: expression}}``."""
    return F.inline(F.array(*(
        F.struct(F.lit(p).alias(name), *(c.alias(k) for k, c in fields.items()))
        for p, fields in columns.items()
    )))


def raw_accounting(raw: DataFrame) -> DataFrame:
    """Rows read, rows with a readable timestamp, rows of target parameters: one pass."""
    readable = S.parse_hour(F.col("date_gmt"), F.col("time_gmt")).isNotNull()
    target = F.trim(F.col("parameter_code").cast("string")).isin(*C.PARAMETER_CODES)
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(readable).alias("rows_after_ts_parse"),
        F.count_if(readable & target).alias("rows_after_param_filter"),
    )


def schema_metrics(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Row accounting of the raw rows next to the size of the complete grid (two one-row tables)."""
    width = len([c for c in ("station_id", "timestamp_utc", *C.POLLUTANTS, *cleaning.METADATA) if c in clean.columns])
    grid = station_counts(clean).filter(F.col("pollutant") == C.POLLUTANTS[0]).agg(
        F.coalesce(F.sum("hours"), F.lit(0)).alias("pivoted_rows"),
        F.lit(width).cast("long").alias("pivoted_cols"),
        F.count(F.lit(1)).alias("station_count"),
    )
    return _side_by_side(raw_accounting(raw), grid)


def _side_by_side(*tables: DataFrame) -> DataFrame:
    """Join one-row tables on a constant."""
    out = tables[0].withColumn("_one", F.lit(1))
    for table in tables[1:]:
        out = out.join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def station_counts(df: DataFrame) -> DataFrame:
    """Hours, readings and flag counts per station and pollutant: the one pass all reports share."""
    flags = [f for f in ("interp", "neg", "bounds", "drift") if f"{C.POLLUTANTS[0]}_{f}_flag" in df.columns]
    sums = [F.count(F.lit(1)).alias("_hours")]
    for p in C.POLLUTANTS:
        sums.append(F.count(p).alias(f"_{p}_readings"))
        sums += [F.count_if(F.col(f"{p}_{f}_flag")).alias(f"_{p}_{f}") for f in flags]
    return df.groupBy("station_id").agg(*sums).select("station_id", per_pollutant({
        p: {
            "hours": F.col("_hours"), "readings": F.col(f"_{p}_readings"),
            **{f: F.col(f"_{p}_{f}") for f in flags},
        }
        for p in C.POLLUTANTS
    }))


def stations_by_pollutant(df: DataFrame) -> DataFrame:
    return station_counts(df).groupBy("pollutant").agg(
        F.count_if(F.col("readings") > 0).alias("stations"), F.count(F.lit(1)).alias("station_count"),
    )


def _percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.round(F.try_divide(part, whole) * 100, digits), F.lit(0.0))


def missingness(df: DataFrame) -> DataFrame:
    """Expected and missing hours of the stations that measure a pollutant at all."""
    active = F.col("readings") > 0
    total = F.coalesce(F.sum(F.when(active, F.col("hours"))), F.lit(0))
    gone = F.coalesce(F.sum(F.when(active, F.col("hours") - F.col("readings"))), F.lit(0))
    return station_counts(df).groupBy("pollutant").agg(
        total.alias("total_expected"), gone.alias("missing_count"), _percent(gone, total).alias("missing_pct"))


def _gaps() -> list[Column]:
    """Aggregates over ``station_counts`` rows of the clean table.

    Values removed by bounds were present after the filling.
    """
    filled, observed = F.col("readings") + F.col("bounds"), F.col("readings") + F.col("bounds") - F.col("interp")

    def missing(readings: Column, prefix: str) -> list[Column]:
        total = F.coalesce(F.sum(F.when(observed > 0, F.col("hours"))), F.lit(0))
        gone = F.coalesce(F.sum(F.when(observed > 0, F.col("hours") - readings)), F.lit(0))
        return [total.alias(f"{prefix}total_expected"), gone.alias(f"{prefix}missing_count"), _percent(gone, total).alias(f"{prefix}missing_pct")]

    return [
        F.sum("interp").alias("interpolated"),
        F.coalesce(F.sum(F.when(observed > 0, F.col("hours") - filled)), F.lit(0)).alias("long_gaps_remaining"),
        *missing(observed, "before_"), *missing(filled, "after_"),
    ]


def _outliers() -> list[Column]:
    return [F.sum("neg").alias("negative"), F.sum("bounds").alias("beyond_bounds"), F.sum("drift").alias("drift_flagged")]


def gap_counts(clean: DataFrame) -> DataFrame:
    """Interpolated and still missing hours, with missingness before and after the filling."""
    return station_counts(clean).groupBy("pollutant").agg(*_gaps())


def outlier_counts(clean: DataFrame) -> DataFrame:
    return station_counts(clean).groupBy("pollutant").agg(*_outliers())


GAPS = ("interpolated", "long_gaps_remaining", *(
    f"{side}_{m}" for side in ("before", "after") for m in ("total_expected", "missing_count", "missing_pct")))
OUTLIERS = ("negative", "beyond_bounds", "drift_flagged")
SCHEMA = ("raw_rows", "rows_after_ts_parse", "rows_after_param_filter", "pivoted_rows", "pivoted_cols", "station_count")


def _accumulated(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row with every count of the report, from one pass over each table.

    A station's counts unfold to a row for each pollutant, those are summed, and the sums, a row a pollutant,
    are gathered next to the accounting of the raw rows.
    """
    width = len([c for c in ("station_id", "timestamp_utc", *C.POLLUTANTS, *cleaning.METADATA) if c in clean.columns])
    sums = station_counts(clean).groupBy("pollutant").agg(
        F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("station_count"),
        F.count_if(F.col("readings") > 0).alias("stations"), *_gaps(), *_outliers(),
    )
    gathered = sums.agg(F.sort_array(F.collect_list(F.struct(
        "pollutant", "stations", F.struct(*GAPS).alias("missingness"), F.struct(*OUTLIERS).alias("outliers"), "hours", "station_count",
    ))).alias("counts"))
    size = F.get("counts", F.lit(0))
    return _side_by_side(raw_accounting(raw), gathered).withColumns({
        "pivoted_rows": F.coalesce(size["hours"], F.lit(0)), "pivoted_cols": F.lit(width).cast("long"),
        "station_count": F.coalesce(size["station_count"], F.lit(0)),
    })


def cleaning_report_rows(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """The whole report as ``(section, pollutant, metric, value)``; '' where no pollutant applies."""
    def entry(section: str, pollutant: Column, metric: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), pollutant.alias("pollutant"),
                        F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    whole = F.array(*(entry("schema", F.lit(""), m, F.col(m)) for m in SCHEMA))
    each = F.flatten(F.transform("counts", lambda c: F.array(
        entry("schema", c["pollutant"], "stations", c["stations"]),
        *(entry(section, c["pollutant"], m, c[section][m]) for section, names in (("missingness", GAPS), ("outliers", OUTLIERS)) for m in names),
    )))
    return _accumulated(raw, clean).select(F.inline(F.concat(whole, each)))


def cleaning_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """The report as one nested row, ready for ``to_json`` or a JSON sink."""
    def by_pollutant(value) -> Column:
        return F.map_from_entries(F.transform("counts", lambda c: F.struct(c["pollutant"], value(c))))

    return _accumulated(raw, clean).select(
        F.struct(*SCHEMA, by_pollutant(lambda c: F.struct(c["stations"].alias("stations"))).alias("stations_by_pollutant")).alias("schema"),
        by_pollutant(lambda c: c["missingness"]).alias("missingness"), by_pollutant(lambda c: c["outliers"]).alias("outliers"),
        F.struct(F.col("pivoted_rows").alias("rows"), F.array(*map(F.lit, clean.columns)).alias("columns")).alias("output"),
    )


def dataset_profile(clean: DataFrame) -> DataFrame:
    """Rows, stations and states, through one row per station."""
    stations = clean.groupBy("station_id", "state").agg(F.count(F.lit(1)).alias("hours"))
    return stations.agg(
        F.coalesce(F.sum("hours"), F.lit(0)).alias("rows"),
        F.count_distinct("station_id").alias("stations"),
        F.count_distinct("state").alias("states"),
    )
