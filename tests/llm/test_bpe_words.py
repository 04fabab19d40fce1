"""Proposals by one table, and batches that mix known and new words."""

from __future__ import annotations

from llm import bpe
from llm.queries import tokenizer_path


def test_one_table_gives_the_longest_match():
    vocab = bpe.vocabulary(tokenizer_path())
    assert all(vocab.prefixes[token] == n for token, n in vocab.ids.items())
    for word in (" international", "aaaaaaaaaaaaab", " Überraschung", "x9$$$", "日本語日本", "a"):
        raw, start, want = word.encode(), 0, []
        while start < len(raw):
            end = next(k for k in range(len(raw), start, -1) if raw[start:k] in vocab.ids)
            want.append(vocab.ids[raw[start:end]])
            start = end
        assert vocab.propose(raw) == want


def test_known_and_new_words_of_a_batch(monkeypatch):
    vocab = bpe.vocabulary(tokenizer_path())
    asked, real = [], vocab.encode_words
    monkeypatch.setattr(vocab, "encode_words", lambda words: asked.append(sorted(words)) or real(words))
    encoder = bpe.Encoder(vocab)
    long = "q" * 300
    first = [x.tolist() for x in encoder.encode_batch(["one two", "", "one two one", f"{long} two"])]
    again = [x.tolist() for x in encoder.encode_batch(["one two", f"one new {long}", f"{long} two"])]
    assert asked == [sorted(["one", " two", " one", long]), sorted([" new", f" {long}", long])]
    assert first[1] == [] and first[0] == again[0] and first[3] == again[2]
    assert [vocab.decode(x) for x in again] == ["one two", f"one new {long}", f"{long} two"]
