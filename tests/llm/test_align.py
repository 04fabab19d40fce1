from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import align, bpe
from llm.queries import QUERIES, tokenizer_path
from tests.llm.helpers import SF_DIR
from tests.llm.test_pieces import ODD

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
MORE = ["one two three", "one two three", "<|endoftext|> is text", "x" * 5000, " " * 3000 + "a", "\n" * 700, "日本語" * 400, "naïve café 12345 " * 200]


@pytest.fixture(scope="module")
def libraries():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, bytes) of both tokenizers, from the libraries."""
    one, two = libraries
    letters = bpe.byte_letters()
    first = [(k, bytes(letters[c] for c in one.id_to_token(k))) for k in one.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for k in two.encode(text):
        piece = two.id_to_piece(k)
        second.append((k, bytes([int(piece[1:-1], 16)]) if two.is_byte(k) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    same = text and all(b"".join(x for _, x in side) == raw for side in (first, second))
    return (first, second) if same else ([], [])


def spans(side):
    ends = np.cumsum([len(x) for _, x in side]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True)) if side else []


def brute(libraries, texts):
    each = []
    for text in texts:
        a, b = tokens(libraries, text or "")
        sa, sb = spans(a), spans(b)
        links, low = [], 0
        for (k, _), (s, e) in zip(a, sa, strict=True):
            while low < len(sb) and sb[low][1] <= s:
                low += 1
            j = low
            while j < len(sb) and sb[j][0] < e:
                links.append((k, b[j][0]))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        ia = ib = 0
        for cut in cuts:
            ga, gb = [], []
            while ia < len(a) and sa[ia][1] <= cut:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and sb[ib][1] <= cut:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
            start = cut
        each.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for *_, links, _ in each for p in set(links))
    best = {}
    for (k, _), n in count.items():
        best[k] = max(best.get(k, 0), n)
    return [(na, nb, ng, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest)
            for na, nb, ng, links, digest in each]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_runs_equal_a_plain_merge():
    rng = random.Random(1)
    for _ in range(3000):
        total = rng.randrange(1, 60)
        a, b = (sorted({total, *rng.sample(range(1, total + 1), rng.randrange(total))}) for _ in range(2))
        if rng.random() < 0.5:
            b = sorted({total, *(x for x in a if rng.random() < 0.9)})
        want, i, j = [], 0, 0
        while i < len(a):
            if a[i] == b[j]:
                i, j = i + 1, j + 1
            else:
                want.append((i, j))
                i, j = (i + 1, j) if a[i] < b[j] else (i, j + 1)
        assert list(zip(*align.irregular_steps(a, b), strict=True)) == want
    assert align.irregular_steps([], []) == ([], [])


def test_statistics_equal_brute_force(spark, libraries, monkeypatch):
    texts = [*ODD, *MORE]
    df = spark.createDataFrame([(k, t, "a", "b", "c") for k, t in enumerate(texts)], "doc_id long, text string, block string, _0 string, pairs string")
    out = align.link_statistics(df.repartition(5), A, B).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in out] == brute(libraries, texts)
    assert all((r["block"], r["_0"], r["pairs"]) == ("a", "b", "c") for r in out)
    assert align.link_statistics(df.limit(0), A, B).count() == 0


def test_groups(spark, libraries):
    texts = [*ODD, *MORE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in align.token_groups(df, A, B).collect():
        text = texts[row["doc_id"]] or ""
        a, b = tokens(libraries, text)
        assert row["a_ids"] == [k for k, _ in a] and row["b_ids"] == [k for k, _ in b]
        assert [g["byte_end"] for g in row["groups"]] == sorted({e for _, e in spans(a)} & {e for _, e in spans(b)})
        for g in row["groups"]:
            assert len(b"".join(x for _, x in a[:g["a_end"]])) == len(b"".join(x for _, x in b[:g["b_end"]])) == g["byte_end"]


def test_query(spark, libraries):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], brute(libraries, [r["text"] for r in docs]), strict=True))
    out = QUERIES["op13_diagonal_alignment"](spark, SF_DIR).collect()
    assert len(out) == len(docs)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out} == want


def test_long_texts(libraries):
    both = align.aligner(A, B)
    for text in ("a" + " " * 300_000 + "b", "\n " * 100_000, "word " * 100_000, "x" * 200_000):
        found = both.align([text])[0]
        assert found.ends_a[-1] == len(text) + 1 and len(found.link_a) == len(found.a) + len(found.b) - len(found.at_a)
        assert list(zip(found.a.tolist(), found.b.tolist(), strict=False))[:3] == list(zip(*([k for k, _ in s][:3] for s in tokens(libraries, text)), strict=False))
