"""Tables written between the steps of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hourgrid.session import scratch_dir


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a step's result once and go on from the files.

    Later steps read it several times; the written table spares them the steps before, and unlike a cache
    it outlives lost executors.
    """
    target = path or scratch_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
