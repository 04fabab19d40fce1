"""Writers. Each returns the path it wrote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators import ingest


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        # One task per partition value would be slow for a hot value, so only the size is bounded.
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def _stored_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys of the store's directories, from its file listing: one row a file, no file is opened."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return files.select(key).distinct() if key in files.columns else None


def land_new_chunks(batch: DataFrame, path: str, key: str = "chunk_key") -> str:
    """Append the chunks of a batch that the store does not hold yet.

    Chunks are directories (``key=value``): a rerun after a lost job replaces the directories it writes
    and leaves all others as they are.
    """
    stored = _stored_keys(batch.sparkSession, path, key)
    new = batch if stored is None else ingest.resume_filter(
        batch.withColumnRenamed(key, "chunk_key"), stored.withColumnRenamed(key, "chunk_key")
    ).withColumnRenamed("chunk_key", key)
    write_parquet(new.withColumn(key, F.col(key).cast("string")), path, [key])
    return path
