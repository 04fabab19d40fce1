"""Byte-level BPE by speculation: propose by longest match, check all adjacent pairs at once, merge the rest.

A word's proposal is its greedy split into longest tokens. Two neighbours are compatible if no merge ever
joins bytes across their boundary while each is built up; a sequence whose neighbours are all compatible is
what merging gives. The check walks down the last parts of the left token and the first parts of the right
one, for all pairs of all new words together. Only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import functools
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the byte-level format: how a text falls into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Code points whose classes do not depend on the version of the Unicode tables; others go by the library's own split.
_STABLE = regex.compile("[\u0000-Ֆ֐-׿ऄ-ह‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")
_CACHED, _CACHED_CHARS, _LONG = 400_000, 1 << 23, 256
_NONE = np.int64(1) << 40
_FAR = 1 << 40


def is_stable(text: str) -> bool:
    """Whether every version of the Unicode tables splits this text alike."""
    return text.isascii() or _STABLE.fullmatch(text) is not None


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and the compatibility of neighbours, from a byte-level BPE file of the tokenizers library.

    Token ids must rise in the order of merges, as they do in files of this kind; anything else is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): n for token, n in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ids = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * top
        for token, n in vocab.items():
            self.bytes[n] = token
        for text, n in self.special.items():
            self.bytes[n] = text.encode()
        self.objects = np.array(self.bytes, object)
        self.left, self.right = np.full(top, -1), np.full(top, -1)
        pairs = []
        for one, two in merges:
            a, b = (bytes(letters[c] for c in x) for x in (one, two))
            whole = vocab[a + b]
            self.left[whole], self.right[whole] = vocab[a], vocab[b]
            pairs.append((vocab[a] << 32 | vocab[b], whole))
        self.rank = dict(pairs)
        made = np.array([n for _, n in pairs])
        if (np.diff(made) <= 0).any() or (self.left[made] >= made).any() or (self.right[made] >= made).any():
            raise ValueError("token ids do not follow the order of merges")
        pairs.sort()
        self._pair = np.array([p for p, _ in pairs], np.int64)
        self._whole = np.array([n for _, n in pairs], np.int64)
        # Every beginning of a token, with the token's id or -1.
        self.prefixes = dict.fromkeys((token[:k] for token in vocab for k in range(1, len(token))), -1) | vocab
        self._path = path
        self._split = regex.compile(PATTERN)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self._path).pre_tokenizer

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if is_stable(text):
            return self._split.findall(text)
        at = [span for _, span in self._library.pre_tokenize_str(text)]
        return [text[a:b] for a, b in at]

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text in order."""
        if self._cut is None or "<|" not in text and not self._cut.search(text):
            return self.words(text)
        parts = self._cut.split(text)
        return list(chain.from_iterable([p] if k % 2 else self.words(p) for k, p in enumerate(parts)))

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        out, start, size, get = [], 0, len(word), self.prefixes.get
        while start < size:
            # A single byte is always a token.
            end = best = start + 1
            token = get(word[start:end])
            while end < size and (longer := get(word[start:end + 1])) is not None:
                end += 1
                if longer >= 0:
                    best, token = end, longer
            out.append(token)
            start = best
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: whether no merge crosses their boundary."""
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        until_a, until_b = np.full(len(a), _NONE), np.full(len(a), _NONE)  # the merge that consumes each part
        while len(live):
            key = a << 32 | b
            at = np.searchsorted(self._pair, key)
            at[at == len(self._pair)] = 0
            whole = np.where(self._pair[at] == key, self._whole[at], _NONE)
            # Of equal merges the leftmost comes first: the boundary loses to the left token, not to the right one.
            bad = (whole < until_a) & (whole <= until_b) & (whole < _NONE)
            fine[live[bad]] = False
            down_a = a > b
            nxt = np.where(down_a, self.right[a], self.left[b])
            keep = ~bad & (nxt >= 0)
            until_a, until_b = np.where(down_a, a, until_a)[keep], np.where(down_a, until_b, b)[keep]
            a, b = np.where(down_a, nxt, a)[keep], np.where(down_a, b, nxt)[keep]
            live = live[keep]
        return fine

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest merge first and leftmost among equals."""
        if len(word) > 48:
            return self._merge_long(word)
        get = self.rank.get
        token = [self.ids[word[k:k + 1]] for k in range(len(word))]
        rank = [get(a << 32 | b, _FAR) for a, b in pairwise(token)]
        while rank and (whole := min(rank)) < _FAR:
            k = rank.index(whole)
            token[k:k + 2] = [whole]
            del rank[k]
            if k:
                rank[k - 1] = get(token[k - 1] << 32 | whole, _FAR)
            if k < len(rank):
                rank[k] = get(whole << 32 | token[k + 1], _FAR)
        return token

    def _merge_long(self, word: bytes) -> list[int]:
        """The same in n log n."""
        token = [self.ids[word[k:k + 1]] for k in range(len(word))]
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        heap = [(r, k) for k in range(n - 1) if (r := rank.get(token[k] << 32 | token[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            whole, k = heapq.heappop(heap)
            j = after[k]
            if token[k] < 0 or j >= n or rank.get(token[k] << 32 | token[j]) != whole:
                continue
            token[k], token[j] = whole, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if (r := rank.get(whole << 32 | token[after[j]])) is not None:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank.get(token[before[k]] << 32 | whole)) is not None:
                heapq.heappush(heap, (r, before[k]))
        return [t for t in token if t >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word: proposed, checked together, merged where the check fails."""
        raw = [w.encode() for w in words]
        found = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))
        if len(flat) > 1:
            word = np.repeat(np.arange(len(found)), lengths)
            inner = np.flatnonzero(word[1:] == word[:-1])
            failing = inner[~self.compatible(flat[inner], flat[inner + 1])]
            for k in np.unique(word[failing]).tolist():
                found[k] = self.merge(raw[k])
        return found

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(self.objects[np.asarray(ids, np.int64)].tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts with a cache of words bounded in entries and characters, which goes when it is full.

    ``special=False`` takes the strings of special tokens as plain text.
    """

    def __init__(self, vocab: Vocabulary, cached: int = _CACHED, chars: int = _CACHED_CHARS, special: bool = True):
        self.vocab, self.cached, self.chars, self.special = vocab, cached, chars, special
        self.known, self.held = {}, 0

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text. Words are kept as the bytes of their ids, which join without a look at each."""
        if len(self.known) > self.cached or self.held > self.chars:
            self.known, self.held = {}, 0
        if not self.known and self.special:
            self.known = {text: np.int32(n).tobytes() for text, n in self.vocab.special.items()}
        split = [(self.vocab.pieces if self.special else self.vocab.words)(t) for t in texts]
        known = self.known
        # Most texts hold known words only: one look at each word, and sets just of what was not found.
        found = [list(map(known.get, words)) for words in split]
        lacking = [k for k, ids in enumerate(found) if None in ids]
        new = list({w for k in lacking for w, ids in zip(split[k], found[k], strict=True) if ids is None})
        known.update((w, array("i", ids).tobytes()) for w, ids in zip(new, self.vocab.encode_words(new), strict=True))
        for k in lacking:
            found[k] = map(known.__getitem__, split[k])
        out = [np.frombuffer(b"".join(ids), np.int32) for ids in found]
        for word in new:
            if len(word) > _LONG:
                del known[word]
            else:
                self.held += len(word)
        return out


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process; tasks that follow one another share its cache."""
    return Encoder(vocabulary(path))


def batches_of_texts(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters; a longer text comes alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _encoded(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for texts in batches_of_texts([t or "" for t in batch.column(at).to_pylist()]):
                ids += encoder(path).encode_batch(texts)
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.list_(pa.int32()))],
                                  names=[*batch.schema.names, "_ids"])

    return run


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and the token ids of its whole texts as ``array<int>``.

    Null and empty texts have no ids; a special token's string in a text is that token. Other columns pass
    unchanged; one named ``ids_col`` is replaced. Rows are independent, so order and repetition don't matter.
    """
    kept = [c for c in df.columns if c != ids_col]
    names = [f"_{k}" for k in range(len(kept))]
    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema), "_ids array<int>"])
    out = inner.mapInArrow(_encoded(path, kept.index(text_col)), schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("_ids").alias(ids_col))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the text of its token ids; null ids give an empty text, unknown ids an error."""
    kept = [c for c in df.columns if c != text_col]
    names = [f"_{k}" for k in range(len(kept))]
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            flat = batch.column(at)
            text = [vocab.decode(x.values.to_numpy() if x.is_valid else ()) for x in flat]
            yield pa.record_batch([*batch.columns, pa.array(text, pa.string())], names=[*batch.schema.names, "_text"])

    inner = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema), "_text string"])
    return inner.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("_text").alias(text_col))
