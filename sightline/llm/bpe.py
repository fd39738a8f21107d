"""Encoding of texts with a byte-level BPE vocabulary: speculate by longest match, verify neighbours, repair failures.

A sequence of tokens is the BPE encoding of a word exactly if every two neighbours are the encoding of their joint
bytes. So a greedy longest match proposes tokens for each new word, one vectorised check tests every adjacent pair of
all new words at once (undoing the later of the two merges step by step and looking for an earlier merge across the
border), and only words with a failing pair go through the exact merging. Words seen before come from a cache in the
worker; the cache changes no result.

Defined results: NULL and empty texts give an empty list; blanks are encoded like other characters; a special token's
name in a text is ordinary text; a word of any length is merged in n log n steps; repeated rows give repeated results;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the public pattern that splits text into words before this family of vocabularies merges bytes.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 300_000
CHUNK_CHARS = 500_000
_FAR = np.iinfo(np.int64).max


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A vocabulary with its merges. Inside, a token is named by its rank: 0-255 single bytes, then the merges in order."""

    def __init__(self, content: bytes, pattern: str = WORD_PATTERN) -> None:
        model = json.loads(content)["model"]
        letters = _byte_letters()
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        base = {c: b for c, b in letters.items()}
        rank_of = {c: base[c] for c in letters}
        n = 256 + len(merges)
        self.left, self.right, self.ids = np.arange(n), np.arange(n), np.zeros(n, dtype=np.int32)
        for c, b in base.items():
            self.ids[b] = ids[c]
        for i, (a, b) in enumerate(merges):
            self.left[256 + i], self.right[256 + i], self.ids[256 + i] = rank_of[a], rank_of[b], ids[a + b]
            rank_of.setdefault(a + b, 256 + i)
        self.tokens = {bytes(letters[c] for c in t): r for t, r in rank_of.items()}
        self.longest = max(map(len, self.tokens))
        key = self.left[256:].astype(np.int64) * n + self.right[256:]
        order = np.argsort(key)
        self.n, self.key, self.merged = n, key[order], order + 256
        self.pairs = dict(zip(key.tolist(), range(256, n)))
        self.words = regex.compile(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}

    def propose(self, word: bytes) -> list[int]:
        """The longest tokens from left to right."""
        tokens, at, out, n = self.tokens, 0, [], len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (rank := tokens.get(word[at:end])) is None:
                end -= 1
            out.append(rank)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbouring tokens is the encoding of its joint bytes."""
        good = np.ones(len(a), dtype=bool)
        live, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _FAR)
        while len(live):
            key = a * self.n + b
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            joined = np.where(self.key[at] == key, self.merged[at], _FAR)
            crossed = joined < limit
            good[live[crossed]] = False
            inner_a, inner_b = self.right[a], self.left[b]
            a_atom, b_atom = inner_a == a, inner_b == b
            open_a = (~a_atom & (a > b)) | (b_atom & ~a_atom)
            open_b = ~open_a & ~b_atom
            limit = np.where(open_a, a, b + 1)
            a, b = np.where(open_a, inner_a, a), np.where(open_b, inner_b, b)
            on = ~crossed & (open_a | open_b)
            live, a, b, limit = live[on], a[on], b[on], limit[on]
        return good

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding: the earliest merge first, the leftmost of equals."""
        n, pairs, size = len(word), self.pairs, self.n
        token = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := pairs.get(token[i] * size + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i] if token[i] >= 0 else n
            if token[i] != x or j >= n or token[j] != y:
                continue
            token[i], token[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(rank * size + token[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, token[k]))
            p = before[i]
            if p >= 0 and (r := pairs.get(token[p] * size + rank)) is not None:
                heapq.heappush(heap, (r, p, token[p], rank))
        return [t for t in token if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Put the encodings of new words into the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        found = [self.propose(w) for w in raw]
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(count.sum()))
        owner = np.repeat(np.arange(len(found)), count)
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        both, back = np.unique(flat[pair] * self.n + flat[pair + 1], return_inverse=True)
        good = self.compatible(both // self.n, both % self.n)
        for k in np.unique(owner[pair[~good[back]]]).tolist():
            found[k] = self.merge(raw[k])
        for w, ranks in zip(words, found):
            self.cache[w] = tuple(self.ids[ranks].tolist())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids of each."""
        split = [self.words.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list({w for words in split for w in words if w not in self.cache})
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        parts = [list(chain.from_iterable(map(get, words))) for words in split]
        count = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        return np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(count.sum())), count


_LOADED: dict[int, Bpe] = {}


def _chunks(column: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in column.to_pylist():
        part.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(df: DataFrame, id_col: str, text_col: str, tokenizer_json: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """``id_col`` and ``ids``, the token ids of ``text_col`` without special tokens.

    ``tokenizer_json`` is the path of the vocabulary on the driver; its content, a file of fixed size, is broadcast.
    """
    with open(tokenizer_json, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = content.value
        bpe = _LOADED.get(hash((raw, pattern)))
        if bpe is None:
            bpe = _LOADED[hash((raw, pattern))] = Bpe(raw, pattern)
        for b in batches:
            at = 0
            for texts in _chunks(b.column(1)):
                ids, count = bpe.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], names=[id_col, "ids"])
                at += len(texts)

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
