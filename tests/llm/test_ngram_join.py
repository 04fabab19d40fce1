from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from llm import ngram_join as N
from tests.llm.helpers import DOCS, SF_DIR, least_reachable, texts


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def expected(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    pairs = [(a, b) for (a, x), (b, y) in combinations(sets, 2)
             if a is not None and b is not None and (a == b or x and y and 100 * len(x & y) >= 80 * len(x | y))]
    least = least_reachable({i for i, _ in sets if i is not None}, pairs)
    return sorted((str(i), len(s), least.get(i)) for i, s in sets)


def result(df, **names):
    return sorted((str(a), b, c) for a, b, c in N.jaccard_components(df, **names).collect())


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = list(enumerate(texts(rng, 300)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == expected(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\r\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (None, "one two"),
            (7, long), (8, long + " tail"), (9, "a\xa0b c d e f"), (9, "one two three"), (1, None), (4, "one two"), (10, "É x"), (11, "é x")]
    df = spark.createDataFrame([(*r, "keys", 5) for r in rows], "doc_id long, text string, digest string, n long")
    assert result(df) == expected(rows)


def test_empty_table_and_other_names(spark):
    assert N.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = N.jaccard_components(spark.createDataFrame([(5, "a b c d e")], "k int, body string"), "k", "body")
    assert got.columns == ["k", "n_shingles", "component_id"] and got.first()[1:] == (1, 5)


@pytest.mark.parametrize("block", [3, 2048])
def test_large_tiles_are_cut_without_losing_links(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(9)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for i in range(40):
        one = list(base)
        for _ in range(3):
            one[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(one)))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_bitmap_bound_never_drops_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        one = rng.integers(0, 2**64, n, dtype=np.uint64)
        two = np.unique(np.concatenate((one[int(rng.integers(0, n // 8 + 1)):], rng.integers(0, 2**64, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64))))
        one = np.unique(one)
        sets = sorted((one, two), key=len)
        both = len(np.intersect1d(one, two))
        if 100 * both >= 80 * (len(one) + len(two) - both):
            found = list(N._partners(np.zeros(2, np.int64), np.array([len(s) for s in sets]), np.arange(2), np.zeros(2), np.ones(2, bool), [N.parity_bitmap(s) for s in sets]))
            assert len(found) == 1


def test_near_copies_keep_all_texts_of_a_reused_id(spark):
    import corpus_pipeline

    one, two = ("first text of five words", "x", "s", 24), ("second unlike story told in other terms", "x", "s", 39)
    rows = [(1, *one), (1, *two), (1, *one), (2, None, "x", "b", 0), (2, None, "x", "a", 0), (2, "some third thing to read here", "x", "s", 29), (3, *one)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), SF_DIR).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, *one), (1, *two), (2, None, "x", "a", 0), rows[5]], key=str)


def test_rows_without_a_neighbour_in_size_leave_their_key():
    rng = np.random.default_rng(3)
    rows = sorted({(int(k), int(n), i) for i, (k, n) in enumerate(zip(rng.integers(0, 40, 300), rng.integers(1, 60, 300)))})
    want = [(k, r) for k, n, r in rows if any(
        q == k and s != r and min(n, m) >= -(-N.PERCENT * max(n, m) // 100) for q, m, s in rows)]
    assert 0 < len(want) < len(rows)
    for size in (1, 2, 7, 300):
        batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size])], names=["key", "n", "rep"]) for i in range(0, len(rows), size)]
        out = [row for b in N._runs(iter(batches)) for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert sorted(out) == sorted(want) and len(out) == len(want)
