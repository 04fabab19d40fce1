"""WARC archives as a Python data source, with a reader that parses headers before anything else.

Reading plans a partition for each group of files, takes record-type and header predicates into the scan, and
looks at a record's payload only if its headers match. Writing gives one gzip member for each record; files
appear under their final names when the whole job has succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from llm.common import drop_staged, stage

FORMAT = "warc_archive"
LEAST_REVISIT = 1000
#: Up to so many digests of copied payloads go to every executor, some 30 MB.
SENT_DIGESTS = 1 << 18
FILE_BYTES = 64 << 20
_BATCH_BYTES = 8 << 20
_PIECE = 1 << 20

#: Columns that are headers, by column name.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join([*(f"{c} string" for c in HEADERS), "content_length long", "http_length long", "payload binary"])
_ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("content_length", pa.int64()), ("http_length", pa.int64()), ("payload", pa.binary())])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or of a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# -- records ----------------------------------------------------------------------------------------------

def http_block(payload_bytes: int, payload: bytes = b"") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode() + payload


def _safe(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_safe(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sha1_hex(label: str | None) -> str | None:
    """Lower-case hex of a digest header, which may be in base 32 or hex."""
    if not label or not label.lower().startswith("sha1:"):
        return None
    value = label[5:]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# -- writing ----------------------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class WarcWriter(DataSourceArrowWriter):
    """One or more files for each task; a retried or speculative task leaves only unnamed files behind."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        fs.create_dir(f"{root}/_unfinished", recursive=True)
        stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        names, out, size = [], None, 0
        for batch in iterator:
            columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                row = {c: columns[c][k].as_py() if c in columns else None for c in (*HEADERS, "http_length", "payload")}
                payload = row["payload"] or b""
                length = row["http_length"] if row["http_length"] is not None else len(payload)
                headers = {h: row[c] for c, h in HEADERS.items()}
                headers["WARC-Date"] = row["date"] or stamp
                headers["Content-Type"] = row["content_type"] or "application/http;msgtype=response"
                if row["record_type"] == "revisit":
                    headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                data = _member(record(headers, http_block(length, payload)))
                if out is None or size + len(data) > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    names.append((f"{root}/_unfinished/{name}", f"{root}/{name}"))
                    out, size = fs.open_output_stream(names[-1][0], compression=None), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, _ = _place(self.path)
        for message in messages:
            for old, new in message.names if message is not None else ():
                fs.move(old, new)

    def abort(self, messages) -> None:
        fs, _ = _place(self.path)
        for message in messages:
            for old, _ in message.names if message is not None else ():
                fs.delete_file(old)


# -- reading ----------------------------------------------------------------------------------------------

class _Source:
    """Bytes of a plain or gzipped archive; skipping does not keep what it passes."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed = stream, packed
        self.raw, self.held, self.at = b"", b"", 0
        self.unzip = zlib.decompressobj(31) if packed else None

    def _more(self) -> bytes:
        while True:
            if not self.packed:
                return self.stream.read(_PIECE)
            if self.unzip.eof:
                self.raw = self.unzip.unused_data or self.raw
                self.unzip = zlib.decompressobj(31)
            data = self.raw or self.stream.read(_PIECE)
            self.raw = b""
            if not data:
                return b""
            out = self.unzip.decompress(data, _PIECE)
            self.raw = self.unzip.unconsumed_tail
            if out:
                return out

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the mark, which is passed; None at the end of the archive."""
        while (k := self.held.find(mark, self.at)) < 0:
            data = self._more()
            if not data:
                if self.held[self.at:].strip():
                    raise ValueError("archive ends within a header")
                return None
            self.held, self.at = self.held[self.at:] + data, 0
        out = self.held[self.at:k]
        self.at = k + len(mark)
        return out

    def take(self, n: int, keep: bool) -> bytes:
        out = []
        while n:
            if self.at == len(self.held):
                self.held, self.at = self._more(), 0
                if not self.held:
                    raise ValueError("archive ends within a record")
            part = min(n, len(self.held) - self.at)
            if keep:
                out.append(self.held[self.at:self.at + part])
            self.at += part
            n -= part
        return b"".join(out)


def parse_headers(raw: bytes) -> dict[str, str]:
    """Header fields in lower case; folded lines continue the one before."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    out, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def split_http(block: bytes) -> tuple[int | None, bytes]:
    """Content-Length of an HTTP message and its body."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return None, block
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value), body
    return None, body


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    """Scans whole files; predicates on header columns are tested before a record's block is looked at."""

    def __init__(self, path: str, payload: bool, target: int):
        self.path, self.payload, self.target = path, payload, target
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", frozenset(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or kind == "in" and own not in value or kind == "starts" and not own.startswith(value):
                return False
        return True

    def partitions(self):
        fs, root = _place(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Files([root])]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=False))
        files = [(f.size, f.path) for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz"))
                 and not any(p[0] in "._" for p in f.path[len(root):].split("/") if p)]
        groups: list[Files] = []
        size = 0
        for length, path in sorted(files, key=lambda f: f[1]):
            if not groups or size + length > self.target:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(path)
            size += length
        return groups or [Files([])]

    def read(self, partition: Files):
        fs, _ = _place(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as stream:
                for row in self._records(_Source(stream, path.endswith(".gz"))):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _records(self, source: _Source):
        while (raw := source.until(b"\r\n\r\n")) is not None:
            headers = parse_headers(raw.lstrip(b"\r\n"))
            row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
            row["content_length"] = n = int(headers["content-length"])
            if not self._wanted(row):
                source.take(n + 4, False)
                continue
            http = (row["content_type"] or "").lower().startswith("application/http")
            if self.payload or row["record_type"] == "revisit":
                row["http_length"], body = split_http(source.take(n, True)) if http else (None, source.take(n, True))
                row["payload"] = body if self.payload and row["record_type"] != "revisit" else None
                source.take(4, False)
            else:
                source.take(n + 4, False)
                row["http_length"] = row["payload"] = None
            yield row


class WarcSource(DataSource):
    """Options: path; payload ("false" leaves payloads alone); target (bytes of files to a partition)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false",
                          int(self.options.get("target", 16 << 20)))

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options["path"])


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Records of a file or of all archives below a folder; an empty folder gives no rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format(FORMAT).options(**options).load(path)


def _urn(column):
    return F.concat(F.lit("<urn:page:"), F.coalesce(column.cast("string"), F.lit("null")), F.lit(">"))


def page_of(column):
    """The page id in a record id; null if the page had none."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(-?[0-9]+)>$', 1) AS bigint)")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for each row of ``pages``: a response, or a revisit of the response with an equal payload.

    Payloads of at least 1000 bytes that occur more than once have one response, that with the largest id;
    rows that repeat that id are responses too, rows with other or null ids are revisits of it. If all their
    ids are null, all are responses. Null html is an empty payload, a null url leaves its header out.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    # Copies are counted on narrow rows. Where few payloads have any, their digests go to the pages, which stay
    # where they are; beyond that pages meet them by digest.
    copied = stage(rows.where(f"n >= {LEAST_REVISIT}").groupBy("digest").agg(F.count("*").alias("rows"), F.max("id").alias("first")).where(
        "rows > 1 AND first IS NOT NULL").select("digest", "first"), "copied")
    full = rows.join(F.broadcast(copied) if copied.count() <= SENT_DIGESTS else copied.hint("merge"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    full.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _urn(F.col("id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.when(revisit, _urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"), F.col("n").alias("http_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format(FORMAT).mode("append").save(path)
    drop_staged(copied)


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """What ``archive`` wrote: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Two scans, each with its record type pushed down; revisits have no payload, their size and digest are
    those that their headers tell.
    """
    def side(kind):
        return read(spark, path).where(F.col("record_type") == kind)

    told = F.lower(F.regexp_extract("payload_digest", "^sha1:([0-9a-fA-F]{40})$", 1))
    common = [page_of("record_id").alias("page_id"), F.col("target_uri").alias("url"), "record_type", page_of("refers_to").alias("refers_to")]
    responses = side("response").select(*common, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "payload")
    revisits = side("revisit").select(*common, F.col("http_length").alias("payload_bytes"), told.alias("payload_digest"), F.lit(None).cast("binary").alias("payload"))
    return responses.unionByName(revisits)
