"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds a row for each pair of
blob and rule version that has been scanned, with what was found. A scan looks only at pairs that the ledger
lacks, once each however many paths hold the blob, appends them, and joins findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` are dropped; a new version scans anew."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost non-overlapping matches, code points, end exclusive."""
        return [m.span() for m in re.finditer(self.pattern, text) if m.end(self.group) - m.start(self.group) >= self.least]


def _either_case(words: str) -> str:
    """ASCII letters in either case; Unicode case folding would also take letters like the long s."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# A run of hexadecimal digits is matched from its length on: the same spans, without stopping at every short run.
RULES = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: The rows of one blob meet its findings in so many tasks.
SPREAD = 16
_LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def _scan(rules: dict[str, Rule]):
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, todo, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                text, blob = text.as_py() or "", blob.as_py()
                for key in todo.as_py():
                    out.append((blob, key, [{"start": a, "end": b} for a, b in rules[key].spans(text)]))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), spans), strict=True)],
                                  names=["blob", "rule", "spans"])

    return run


def blob_of(text_col: str = "text"):
    """Content address; null counts as empty."""
    return F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger, empty where nothing has been written yet."""
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def scan_unseen(versions: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Scan the pairs of blob and rule version that the ledger lacks and append them to it.

    One row stands for each blob, that with the least id, so a blob held by a third of all rows is scanned
    once. Only ids and addresses are grouped; a text moves once, keyed by its own row.
    """
    spark = versions.sparkSession
    by_key = {r.key: r for r in rules}
    rows = versions.select(F.col(f"`{id_col}`").alias("id"), blob_of(text_col).alias("blob"), F.col(f"`{text_col}`").alias("text"))
    blobs = rows.groupBy("blob").agg(F.min("id").alias("least"))
    pairs = blobs.withColumn("rule", F.explode(F.array(*map(F.lit, by_key))))
    todo = pairs.join(read_ledger(spark, ledger).select("blob", "rule"), ["blob", "rule"], "left_anti")
    todo = todo.groupBy("blob", "least").agg(F.collect_set("rule").alias("todo")).withColumnRenamed("blob", "_blob")
    chosen = rows.join(todo, (F.col("blob") == F.col("_blob")) & F.col("id").eqNullSafe(F.col("least")))
    found = chosen.select("blob", "todo", "text").mapInArrow(_scan(by_key), _LEDGER)
    found.write.mode("append").parquet(ledger)


def findings(spark, ledger: str, rules=RULES) -> DataFrame:
    """(blob, spans) for the given rule versions: all spans of a blob by start, then by kind as listed."""
    order = {r.key: k for k, r in enumerate(rules)}
    known = read_ledger(spark, ledger).where(F.col("rule").isin(list(order)))
    # A pair may have been scanned twice, by a repeated row or by two scans at once; its spans are the same.
    span = F.explode("spans").alias("span")
    flat = known.where(F.size("spans") > 0).dropDuplicates(["blob", "rule"]).select("blob", "rule", span)
    place = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    item = F.struct(F.col("span.start").alias("start"), place[F.col("rule")].alias("place"),
                    F.split("rule", "@")[0].alias("kind"), F.col("span.end").alias("end"))
    return flat.groupBy("blob").agg(F.sort_array(F.collect_list(item)).alias("spans"))


def scan(versions: DataFrame, ledger: str | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
         spans_col: str = "spans") -> DataFrame:
    """All columns of ``versions`` and ``spans``: array of (start, place, kind, end), empty where nothing is found.

    Null and empty texts hold nothing; rows with null or equal ids are paths like any other; texts are read
    whole, and an empty table gives no rows. Other columns pass whatever their names; one named ``spans_col``
    is replaced. Without a ledger a new one in the scratch folder is used.
    """
    spark = versions.sparkSession
    path = ledger or scratch(spark, "ledger")
    scan_unseen(versions, path, rules, id_col, text_col)
    kept = [c for c in versions.columns if c != spans_col]
    names = [f"_{k}" for k in range(len(kept))]
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int")
    inner = versions.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], blob_of(text_col).alias("blob"), salt.alias("salt"))
    found = findings(spark, path, rules)
    empty = F.array().cast(found.schema["spans"].dataType)
    # Blobs with findings are few; each meets the rows of its blob in several tasks, however many rows hold it.
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    joined = inner.join(spread, ["blob", "salt"], "left")
    return joined.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.coalesce("spans", empty).alias(spans_col))


def redacted(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    out, done = [], 0
    for start, end in sorted(spans):
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _redact(text, spans):
    return redacted(text, [(s["start"], s["end"]) for s in spans]) if spans else text


def redact(text_col: str = "text", spans_col: str = "spans"):
    """Column form of ``redacted``; texts without spans pass as they are."""
    return F.udf(_redact, "string", useArrow=True)(F.col(text_col), F.col(spans_col))
