from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from llm import pieces
from llm.queries import QUERIES, tokenizer_path
from tests.llm.helpers import SF_DIR

ODD = [None, "", " ", "  a  b ", "a\nb\tc", "\r\n x\n\n", "<s>x</s><unk><0x41>", "▁a ▁▁ b▁", "\x00b", "日本語 텍스트 😀 \U0001f9ff", "zz" * 3_000,
       " " * 50, "don't I'll\n\n\t WE'RE 12,345.67", "퟿ 𝒳𐍈", "﻿x​　y z", "É é ﬁ Ａ", "\n", "a\n", " \n ", "</s>"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_equals_the_library(spark, library):
    path = tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate([*ODD, *ODD])], "doc_id long, text string, ids string, _0 string")
    for end in (False, True):
        out = pieces.decode(pieces.encode(df, path, end=end), path).collect()
        assert len(out) == 2 * len(ODD)
        for row in out:
            want = library.encode(row["text"] or "", add_eos=end)
            assert row["ids"] == want and row["decoded"] == library.decode(want) and row["_0"] == "y"
    assert pieces.encode(df.limit(0), path).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), path).first()["decoded"] == ""


def test_random_chunks_and_ids(library):
    model, rng = pieces.piece_model(tokenizer_path("piece_bpe_32k.model")), random.Random(3)
    table = pieces.ChunkTable(model, cached=500, chars=4000)
    letters = "aenthxyzé1!  \n\r\t▁日ö😀\x00<0x>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    for k in range(0, len(texts), 50):
        assert [x.tolist() for x in table.encode_batch(texts[k:k + 50])] == library.encode(texts[k:k + 50])
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3), 28705, 259]) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", [" " * 1_000_000, "\t" * 1_000_000, "\n" * 1_000_000, "\n " * 500_000, "ab1" * 300_000, "日" * 300_000])
def test_very_long_texts(library, text):
    start, table = time.time(), pieces.ChunkTable(pieces.piece_model(tokenizer_path("piece_bpe_32k.model")))
    ids = table.encode_batch([text])[0]
    assert time.time() - start < 60 and not any(len(c) > pieces._LONG for c in table.known)
    assert table.model.decode(ids) == text
    assert ids.tolist() == library.encode(text)


def test_query(spark, library):
    texts = dict(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect())
    out = QUERIES["op11_distinct_chunks"](spark, SF_DIR).collect()
    assert len(out) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for row in out:
        ids = library.encode(texts[row["doc_id"]] or "", add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
