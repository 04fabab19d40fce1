"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import (
    align, bpe, classifier, conversations, html_extract, metric_join, ngram_join, packing, pieces, posting_lists, secrets, sharding, warc,
)
from llm.common import scratch, small_batches

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op1_tag_path_ratios")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@register("op2_metric_range_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.range_join(table(spark, sf_dir, "embeddings"))


@register("op3_hypergeometric_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_to_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return dealt.select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op4_balanced_posting_lists")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return posting_lists.nearest(rows, rows.where("vec_id % 50 = 0"))


@register("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@register("op6_warc_source", """
    WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
    d AS (SELECT page_id, url, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
    m AS (SELECT payload_digest, max(page_id) AS first FROM d GROUP BY 1)
    SELECT page_id, url, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND page_id != first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id != first THEN first END AS refers_to
    FROM d JOIN m USING (payload_digest)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    return warc.pages_of(spark, path).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op7_bpe_speculate_verify")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    text = bpe.decode(ids, path)
    return text.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op8_compression_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).select(
        "doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op9_secret_ledger")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(list(secrets.BASE)))
    return found.select("doc_id", *map(of_kind, secrets.BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@register("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False).drop("ids")


@register("op11_distinct_chunks")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    ids = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, end=True).drop("text")
    text = pieces.decode(ids, path)
    return text.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _step(way: str, cost: str, letter: str, line: str) -> str:
    return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}', 't': list_concat({way}.t, {line})}}"


def _repair_sql() -> str:
    """Forward steps over the rows of all conversations at once; a way is cost, audit and lines so far."""
    def drop(p):
        return _step(p, "2", "D", "[]")

    def keep(p, initial):
        return (f"CASE WHEN must OR initial != '{initial}' THEN {{'c': 1000000, 'a': '', 't': []::VARCHAR[]}} ELSE "
                + _step(p, "late", "K", "[role || ':' || text]") + " END")

    def rerole(p, role):
        return (f"CASE WHEN must THEN {{'c': 1000000, 'a': '', 't': []::VARCHAR[]}} ELSE "
                + _step(p, "late + 1", "R", f"['{role}:' || text]") + " END")

    def insert(p, role):
        return _step(p, "5", "I", f"['{role}:']")

    before_user = ("p0", "p1", "p3")
    return f"""
    WITH RECURSIVE said AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(
                string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
                lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)),
                    lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 20 AS fault
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
            CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
        FROM said WHERE fault != 0),
    placed AS (
        SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends
        FROM damaged),
    judged AS (
        SELECT *, ends = '' AS blank, ends != '' AND nth > 1 AS duplicate, ends = '' OR nth > 1 AS must,
            ends != '' AND nth = 1 AND right(ends, 1) NOT IN ('.', '!', '?') AS truncated,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au') AS illegal
        FROM placed),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
            count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
        FROM judged GROUP BY conv_id),
    rows AS (SELECT conv_id, k, role, text, initial, must, CASE WHEN truncated THEN 5 ELSE 0 END AS late FROM judged),
    walk AS (
        SELECT conv_id, 0::BIGINT AS k, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS p0, {{'c': 1000000, 'a': '', 't': []::VARCHAR[]}} AS p1,
            {{'c': 5, 'a': 'I', 't': ['user:']}} AS p2, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS p3
        FROM (SELECT DISTINCT conv_id FROM damaged)
        UNION ALL
        SELECT conv_id, k, p0, p1, p2, {_least("p3", insert("p2", "assistant"))} AS p3
        FROM (SELECT conv_id, k, p0, p1, {_least("p2", *(insert(p, "user") for p in before_user))} AS p2, p3
            FROM (SELECT w.conv_id, r.k, {drop("p0")} AS p0, {_least(drop("p1"), keep("p0", "s"))} AS p1,
                    {_least(drop("p2"), *(keep(p, "u") for p in before_user), *(rerole(p, "user") for p in before_user))} AS p2,
                    {_least(drop("p3"), keep("p2", "a"), rerole("p2", "assistant"))} AS p3
                FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1))),
    done AS (
        SELECT w.conv_id, {_least("p0", "p3")} AS best FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.k)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
        coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""


@register("op12_conversation_repair", _repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report = conversations.repair(conversations.damage(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@register("op13_diagonal_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align.link_statistics(rows, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
