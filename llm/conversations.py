"""Conversation structure repair: the cheapest edits that make a conversation ``(system? (user assistant)+)?``.

Edits weigh whole numbers: the high digits of a weight carry the cost, the fixed-width low digits the letters
of the edits from the left, with zeros after the last. The least weight is the cheapest repair and, of equal
costs, the one whose letters come first in ASCII order, so a plain minimum over the nodes (row, state) decides
everything. From one node a letter leads to one other node only; two candidates therefore differ in their
first letter, and digits may be read off block by block: a block of rows is a 4 x 4 table of weights between
states, and tables join by the same minimum. Rows are dealt by range, so a conversation of any length is
worked on in many tasks and only its tables meet.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stage

# Costs of the edits, white space, and the ends of a whole sentence.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
OPEN_END = 5
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}

#: States: nothing yet, after system, after user, after assistant. A rerole or insert makes the only role that may follow.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
DIGIT = {letter: k + 1 for k, letter in enumerate("DIKR")}
_TO_DIGITS, _TO_LETTERS = str.maketrans("DIKR", "1234"), str.maketrans("1234", "DIKR")
_NEVER = 1 << 60
BLOCK = 256
FRAGMENT = 4096


def weigh(cost: int, audit: str, width: int) -> int:
    """Cost in the high digits, then the letters, base 8, padded with zeros at the end."""
    return cost << 3 * width | (int(audit.translate(_TO_DIGITS).ljust(width, "0"), 8) if width else 0)


def read_weight(weight: int, width: int) -> tuple[int, str]:
    low = weight & ((1 << 3 * width) - 1)
    return weight >> 3 * width, f"{low:0{width}o}".rstrip("0").translate(_TO_LETTERS) if low else ""


@functools.lru_cache(maxsize=4096)
def block_table(rows: tuple[str, ...]) -> tuple[tuple[int, str], ...]:
    """Least (cost, audit) from each state to each state over rows; inserts after the last row belong to what follows.

    A row is the initial of its role, with ``+`` where the text is cut off; '' must be deleted.
    """
    width = 3 * len(rows)  # at most two inserts before a row: a third would close a cycle
    shift = 3 * width
    mask = (1 << shift) - 1
    edge = {x: (c << shift) + (DIGIT[x] << shift - 3) for x, c in COST.items()} if rows else {}
    late = OPEN_END << shift
    out = []
    for end in STATES:
        at = [_NEVER << shift] * 4
        at[end] = 0
        for row in reversed(rows):
            rest = [w - (low := w & mask) + (low >> 3) for w in at]  # one letter comes in front
            at = [w + edge[DELETE] for w in rest]
            if row:
                extra = late if row[1:] else 0
                for s in STATES:
                    at[s] = min(at[s], rest[NEXT[s]] + edge[REROLE] + extra)
                    if (kept := KEPT[s].get(row[:1])) is not None:
                        at[s] = min(at[s], rest[kept] + edge[KEEP] + extra)
            plain = at
            for _ in range(2):
                moved = [w - (low := w & mask) + (low >> 3) + edge[INSERT] for w in at]
                at = [min(plain[s], moved[NEXT[s]]) for s in STATES]
        out.append([read_weight(w, width) for w in at])
    return tuple(out[end][start] for start in STATES for end in STATES)


def join_tables(a, b):
    """The table of a block followed by another."""
    width = max(len(x) for _, x in a) + max(len(x) for _, x in b)
    out = []
    for start in STATES:
        for end in STATES:
            ways = [weigh(a[4 * start + m][0] + b[4 * m + end][0], a[4 * start + m][1] + b[4 * m + end][1], width) for m in STATES]
            out.append(read_weight(min(ways), width))
    return tuple(out)


def best_repair(table) -> tuple[int, str]:
    """Cost and audit of a whole conversation: from nothing to nothing or an assistant, with inserts at the end."""
    width = max(len(x) for _, x in table) + 2
    ends = ((EMPTY, ""), (ASSISTANT, ""), (USER, INSERT), (SYSTEM, INSERT * 2))
    return read_weight(min(weigh(table[s][0] + COST[INSERT] * len(more), table[s][1] + more, width) for s, more in ends), width)


NOTHING = block_table(())


# -- rows ------------------------------------------------------------------------------------------------------

def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns after reproducible damage by crc32(``conv_id:turn``) % 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.
    """
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    text, role = F.coalesce(text, space), F.coalesce(role, space)
    return rows.where(fault != 0).select(
        conv.alias(conv_col), turn.alias(turn_col), F.when(fault == 4, "user").otherwise(role).alias(role_col),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _plain(rows: DataFrame, conv_col, turn_col, role_col, text_col) -> DataFrame:
    """conv, turn, role, digest, text; nulls in role and text as one space, no text where it is blank."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    ends = F.rtrim(text, F.lit(BLANKS))
    return rows.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.when(ends != "", text).alias("text"),
        F.when(ends == "", F.lit(None).cast("boolean")).otherwise(~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"))


def _counted(plain: DataFrame) -> DataFrame:
    """A row for each different conv, turn, role and text: how many, cut off (null: blank), and whether it is the first of its role and text."""
    narrow = stage(plain.groupBy("conv", "turn", "role", "digest", "cut").agg(F.count("*").alias("n")), "turns")
    again = narrow.where("cut IS NOT NULL").groupBy("conv", "role", "digest").agg(
        F.count("*").alias("turns"), F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("least")).where("turns > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "none", "least")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    first = F.when(F.col("none"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    return narrow.join(again, same, "left").select(
        "conv", "turn", "role", "digest", "cut", "n", F.when(F.col("d").isNull(), True).otherwise(first).alias("first"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class _Fragment:
    """Counts and the table of consecutive rows of one conversation."""

    def __init__(self):
        self.count = dict.fromkeys(_COUNTS, 0)
        self.least = self.most = self.head = self.tail = None
        self.table, self.codes, self.rows = NOTHING, [], 0

    def add(self, turn, role, cut, n, first):
        initial = role[:1]
        self.rows += n
        real = 0 if cut is None else int(first)
        self.count["blank"] += n if cut is None else 0
        self.count["duplicate"] += 0 if cut is None else n - real
        self.count["truncated"] += bool(real and cut)
        self.count["illegal"] += n - 1 + (self.tail is not None and self.tail + initial not in LEGAL)
        self.head, self.tail = initial if self.head is None else self.head, initial
        if turn is not None and turn != self.most:
            self.count["turns"] += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        for k in range(n):
            self.codes.append((initial or "?") + ("+" if cut else "") if k < real else "")
            if len(self.codes) == BLOCK:
                self.close()

    def close(self):
        table = block_table(tuple(self.codes))
        self.table, self.codes = table if self.table is NOTHING else join_tables(self.table, table), []

    def follow(self, counts, least, most, head, tail, table):
        """Take in the next fragment."""
        for name, n in zip(_COUNTS, counts, strict=True):
            self.count[name] += n
        self.count["illegal"] += self.tail is not None and self.tail + head not in LEGAL
        self.count["turns"] -= least is not None and least == self.most
        self.head, self.tail = head if self.head is None else self.head, tail
        if least is not None:
            self.least, self.most = least if self.least is None else self.least, most
        self.table = table if self.table is NOTHING else join_tables(self.table, table)

    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.count["turns"]


def _fragments(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, part = None, None, None
        for batch in batches:
            out = []

            def give():
                part.close()
                out.append((*key, list(part.count.values()), part.least, part.most, part.head, part.tail,
                            [c for c, _ in part.table], [x for _, x in part.table]))

            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, turn, role, digest, cut, n, first = row
                if part is None or conv != now or part.rows >= FRAGMENT:
                    if part is not None:
                        give()
                    now, key, part = conv, (conv, turn, role, digest), _Fragment()
                part.add(turn, role, cut, n, first)
            yield _record(out, schema)
        out = []
        if part is not None:
            give()
            yield _record(out, schema)

    return run


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Walk:
    """Follows an audit over the rows of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def inserts(self):
        while self.audit[self.at:self.at + 1] == INSERT:
            self.at += 1
            self.state = NEXT[self.state]
            yield INSERT, ROLES[self.state], ""

    def row(self, role: str, text: str):
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == KEEP:
            self.state = KEPT[self.state][role[:1]]
            yield letter, role, text
        elif letter == REROLE:
            self.state = NEXT[self.state]
            yield letter, ROLES[self.state], text


def _finish(schema: pa.Schema, as_rows: bool):
    """Streams sorted rows, the fragments of a conversation before its texts, of which none is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, walk, digest, place, size, out = None, None, None, None, 0, 0, []

        def emit(turn, edits):
            nonlocal place, size
            for letter, role, text in edits:
                if as_rows:
                    out.append((now, place, turn if letter != INSERT else None, letter, role, text))
                    size += len(text)
                else:
                    digest.update(("\n" * bool(place) + f"{role}:{text}").encode())
                place += 1

        def last():
            emit(None, walk.inserts())
            if not as_rows:
                cost, audit = best
                out.append((now, whole.gaps(), *(whole.count[x] for x in _COUNTS[:4]), cost, audit, digest.hexdigest()))

        for batch in batches:
            for kind, conv, turn, role, _, text, counts, least, most, head, tail, costs, audits in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if whole is None or conv != now:
                    if whole is not None:
                        last()
                    now, whole, walk, digest, place = conv, _Fragment(), None, hashlib.sha256(), 0
                if kind == 0:
                    whole.follow(counts, least, most, head, tail, tuple(zip(costs, audits, strict=True)))
                    continue
                if walk is None:
                    best = best_repair(whole.table)
                    walk = _Walk(best[1])
                emit(turn, walk.row(role, text))
                if size > 1 << 22:
                    yield _record(out, schema)
                    out, size = [], 0
            yield _record(out, schema)
            out, size = [], 0
        if whole is not None:
            last()
            yield _record(out, schema)

    return run


_TABLE = "counts array<long>, least long, most long, head string, tail string, costs array<long>, audits array<string>"


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def _repair(rows: DataFrame, columns: str, as_rows: bool, conv_col, turn_col, role_col, text_col) -> DataFrame:
    spark = rows.sparkSession
    plain = _plain(rows, conv_col, turn_col, role_col, text_col)
    kind = plain.schema["conv"].dataType.simpleString()

    def both(ddl):
        ddl = f"conv {kind}, {ddl}"
        return ddl, _arrow(spark.createDataFrame([], ddl).schema)

    ddl, schema = both(f"turn long, role string, digest binary, {_TABLE}")
    order = ["conv", "turn", "role", "digest"]
    dealt = _counted(plain).repartitionByRange(*order).sortWithinPartitions(*order)
    tables = dealt.select(*order, "cut", "n", "first").mapInArrow(_fragments(schema), ddl)
    names = [x.split()[0] for x in _TABLE.split(", ")]
    head = tables.select(F.lit(0).alias("kind"), *order, F.lit(None).cast("string").alias("text"), *names)
    body = plain.select(F.lit(1).alias("kind"), *order, "text", *(F.lit(None).cast(head.schema[n].dataType).alias(n) for n in names))
    met = head.union(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
    ddl, schema = both(columns)
    return met.mapInArrow(_finish(schema, as_rows), ddl).withColumnRenamed("conv", conv_col)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand in order of turn (nulls first), then role, then SHA-256 of the text; rows equal in all of them
    repeat each other. A null conv_id is a conversation of its own, null roles and texts are one space. Other
    columns are not looked at, whatever their names. An empty table gives no rows. A conversation of any
    length is repaired in blocks; its texts stream once through one task, since SHA-256 reads them in order,
    and none of them is kept.
    """
    return _repair(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
                   False, conv_col, turn_col, role_col, text_col)


def repaired_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), turn (null: inserted), edit, role, text."""
    return _repair(rows, "place long, turn long, edit string, role string, text string", True, conv_col, turn_col, role_col, text_col)
