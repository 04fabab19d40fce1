"""The corpus pipeline: quality classifier, n-gram Jaccard join, secret scans, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import classifier, ngram_join, packing, secrets
from llm.common import free_name, scratch, small_batches, stage
from llm.queries import table, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier gives at least even chances of label 1.

    Texts are scored whole, null ones as empty; every row is judged for itself, repeated rows alike, and all
    columns pass whatever their names. An empty table stays empty.
    """
    small_batches(spark)
    score = free_name(docs, "_score")
    model = classifier.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component; rows without an id stay.

    Rows of one id are one document to the join: they stay or go together. Of rows equal in id and text one
    stays, the least by the JSON of its other columns, which may have any type and name. Null and empty texts
    are near copies of nothing; long texts are compared whole; an empty table stays empty.
    """
    small_batches(spark)
    extra = stage(ngram_join.jaccard_components(docs.select("doc_id", "text")), "components").where("component_id != doc_id")
    known = docs.where("doc_id IS NOT NULL").join(extra.select("doc_id").distinct(), "doc_id", "left_anti")
    others = F.struct(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")))
    if len(docs.columns) > 2:
        once = known.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias("row"))
        back = [F.col(f"row._{k}").alias(c) if c not in ("doc_id", "text") else F.col(c) for k, c in enumerate(docs.columns)]
        once = once.select(*back)
    else:
        once = known.distinct()
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark and n_chars counted anew.

    Rows without a secret pass unchanged, null and empty texts among them; repeated rows are treated alike,
    long texts as a whole. All columns pass whatever their names; an empty table stays empty.
    """
    small_batches(spark)
    spans = free_name(docs, "_spans")
    found = secrets.scan(docs, spans_col=spans)
    hit = F.size(spans) > 0
    found = found.withColumn("text", F.when(hit, secrets.redact("text", spans)).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(hit, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1024.

    Null and empty texts are an end id alone; equal rows are documents of their own; a text of any length is
    cut, not cropped. Other columns are not looked at. An empty table gives no rows.
    """
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]
#: The classifier, connected components, secret spans and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
