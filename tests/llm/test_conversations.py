from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from llm import conversations as C
from llm.queries import QUERIES
from tests.llm.helpers import SF_DIR

ROWS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def judged(rows):
    """Rows of one conversation in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """Least (cost, audit, lines) by trying all edits, cheapest first by growing budget."""
    best = None

    def go(k, roles, cost, audit, lines, limit):
        nonlocal best
        if cost > limit or not re.fullmatch("s?(ua)*u?", roles):
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        for role in ("user", "assistant"):
            go(k, roles + role[0], cost + 5, audit + "I", (*lines, role + ":"), limit)
        if k == len(rows):
            return
        _, role, text, fault = rows[k]
        go(k + 1, roles, cost + 2, audit + "D", lines, limit)
        if fault in ("", "truncated"):
            late = 5 if fault else 0
            go(k + 1, roles + (role[:1] or "?"), cost + late, audit + "K", (*lines, f"{role}:{text}"), limit)
            for new in ("user", "assistant"):
                go(k + 1, roles + new[0], cost + late + 1, audit + "R", (*lines, f"{new}:{text}"), limit)

    for limit in itertools.count():
        go(0, "", 0, "", (), limit)
        if best:
            return best


def fast_cheapest(rows):
    """The same for long conversations: tuples over (row, state)."""
    big = (10**9, "", ())
    at = [(0, "", ()), big, big, (0, "", ())]
    for s in (2, 1):
        nxt = C.NEXT[s]
        at[s] = (at[nxt][0] + 5, "I" + at[nxt][1], (C.ROLES[nxt] + ":", *at[nxt][2]))
    for _, role, text, fault in reversed(rows):
        new = []
        for s in C.STATES:
            ways = [(at[s][0] + 2, "D" + at[s][1], at[s][2])]
            if fault in ("", "truncated"):
                late = 5 if fault else 0
                n = C.NEXT[s]
                ways.append((at[n][0] + 1 + late, "R" + at[n][1], (f"{C.ROLES[n]}:{text}", *at[n][2])))
                if (n := C.KEPT[s].get(role[:1])) is not None:
                    ways.append((at[n][0] + late, "K" + at[n][1], (f"{role}:{text}", *at[n][2])))
            new.append(min(ways))
        for _ in range(2):
            new = [min(new[s], (new[C.NEXT[s]][0] + 5, "I" + new[C.NEXT[s]][1], (C.ROLES[C.NEXT[s]] + ":", *new[C.NEXT[s]][2]))) for s in C.STATES]
        at = new
    return at[0]


def brute(rows, search):
    out = {}
    for conv in {r[0] for r in rows}:
        own = judged([r for r in rows if r[0] == conv])
        turns = [t for t, *_ in own if t is not None]
        initials = [r[:1] for _, r, _, _ in own]
        cost, audit, lines = search(own)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(sum(f == x for *_, f in own) for x in ("blank", "duplicate", "truncated")),
                     sum(a + b not in C.LEGAL for a, b in itertools.pairwise(initials)),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_rows(rng, convs, longest):
    texts = ["ok.", "cut", "fine!\n", "a b?", "", " ", " \t\n", "well.", "x", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "unknown", None]
    return [(c, rng.choice([t, t, t, t + 2, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}.")
            for c in [*range(convs), None] for t in range(rng.randrange(longest))]


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_tables_equal_trying_all_edits():
    rng = random.Random(2)
    for _ in range(150):
        rows = [(k, rng.choice(["system", "user", "assistant", "x"]), f"t{k}", rng.choice(["", "", "truncated", "blank"])) for k in range(rng.randrange(6))]
        codes = ["" if f == "blank" else r[:1] + ("+" if f else "") for _, r, _, f in rows]
        want = cheapest(rows)
        assert fast_cheapest(rows) == want
        cut = rng.randrange(len(codes) + 1)
        parts = C.block_table(tuple(codes[:cut])), C.block_table(tuple(codes[cut:]))
        assert C.best_repair(C.join_tables(*parts)) == C.best_repair(C.block_table(tuple(codes))) == want[:2]


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 60, 7) + [(900, 0, "user", "a."), (900, 0, "user", "a."), (900, None, "user", "a."), (901, None, None, None)]
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, ROWS)
    assert found(C.repair(df)) == brute(plain, cheapest)
    changed = C.damage(df)
    assert sorted(map(tuple, changed.collect()), key=str) == sorted(damaged(rows), key=str)
    assert found(C.repair(changed)) == brute(damaged(rows), cheapest)


def test_long_conversation_spans_blocks_fragments_and_partitions(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["system", "user", "user", "assistant", "assistant", "x"]), rng.choice(["fine.", "cut off", f"t{t}.", f"u{t}.", f"v{t}"]))
            for t in range(1500)] + [(2, 0, "user", "hi."), (2, 1, "assistant", "ho.")]
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    assert found(C.repair(df)) == brute(rows, fast_cheapest)


def test_repaired_rows_are_well_formed(spark):
    rows = random_rows(random.Random(9), 40, 8)
    df = spark.createDataFrame(rows, ROWS)
    report, out = found(C.repair(df)), {}
    for r in C.repaired_rows(df).orderBy("conv_id", "place").collect():
        out.setdefault(r["conv_id"], []).append(r)
    for conv, (*_, audit, digest) in report.items():
        own = out.get(conv, [])
        assert [r["place"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in own))
        assert "".join(r["edit"] for r in own) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == digest


def test_edges(spark):
    none = spark.createDataFrame([], ROWS)
    assert C.repair(none).count() == C.repaired_rows(none).count() == C.damage(none).count() == 0
    odd = spark.createDataFrame([("k", 1, "user", "a " * 400_000 + "."), ("k", 2, "assistant", " " * 500_000)], "conv_id string, turn int, role string, text string")
    for name in ("conv", "digest", "cut", "n", "first", "kind", "text_", "counts", "c", "_copy"):
        odd = odd.withColumn(name, F.lit("x"))
    got = C.repair(odd).collect()[0]
    assert (got["conv_id"], got["blank"], got["cost"], got["audit"]) == ("k", 1, 4, "DD")
    same = spark.createDataFrame([(1, 1, "user", "same.")] * 3000, ROWS)
    assert found(C.repair(same))[1][:6] == (0, 0, 2999, 0, 2999, 6000)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(damaged(rows), fast_cheapest)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(QUERIES["op12_conversation_repair"](spark, SF_DIR)) == {c: want.get(c, empty) for c in {r[0] for r in rows}}
