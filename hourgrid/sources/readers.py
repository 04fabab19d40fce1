"""Scans with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourgrid import schemas


def _rows_of(wanted: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of whole parquet files in the wanted columns; a file without columns holds none, a damaged one fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    file = pq.ParquetFile(pa.BufferReader(content.as_buffer()))
                except pa.ArrowException as error:
                    raise ValueError(f"no readable parquet file: {name}") from error
                present = set(file.schema_arrow.names)
                if not present:
                    continue
                for rows in file.iter_batches(columns=[n for n in wanted.names if n in present]):
                    columns = [rows.column(f.name).cast(f.type) if f.name in present else pa.nulls(rows.num_rows, f.type) for f in wanted]
                    yield pa.record_batch(columns, schema=wanted)

    return run


def scan_chunks(spark: SparkSession, path: str, schema: T.StructType = schemas.RAW_LONG) -> DataFrame:
    """Many chunk files below a folder as one table; columns a chunk lacks are null.

    Chunks of requests without data are parquet files without any column, which Spark's parquet reader does
    not accept. Files are planned by Spark and opened by the task that reads them, which looks at the footer
    before any row, so no list of paths is kept anywhere and no size tells one kind of file from another. A
    file that is damaged fails the scan. Chunks hold a request's answer and are read whole: for merged tables
    with filters to push down there is ``scan_table``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_rows_of(to_arrow_schema(schema)), schema)


def scan_hours(spark: SparkSession, merged: str, chunks: str, schema: T.StructType = schemas.RAW_LONG) -> DataFrame:
    """The merged table where it has been written, else its chunks."""
    try:
        return spark.read.schema(schema).parquet(merged)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return scan_chunks(spark, chunks, schema)


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observation records as JSON, one array or one record per line."""
    return spark.read.schema(schemas.LIVE_OBSERVATIONS).json(path)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def file_row_counts(files: DataFrame) -> DataFrame:
    """Rows per file of a file scan, no data column read."""
    return files.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
