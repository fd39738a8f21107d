"""Evaluation texts inside training documents, by an FM-index over each shard of the corpus.

Every run of :data:`PHRASE` words of an item is a test phrase, however many items share it (an item with fewer words is
one phrase as a whole). Each shard of documents becomes one sequence of word numbers with its suffix array, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All test phrases are searched backwards at
once through wavelet ranks; their occurrences are located by walking to the next sampled position. The located places
give the result: those of one item in one document with at most :data:`GAP` other words between them form a passage; a
passage of :data:`LEAST_PASSAGE` found words (or half of a shorter item) counts; a document repeats the item if its
passages hold half of the item's words, in any order. The passages are the removal spans, merged per document.

So a passage tolerates single changed, lost and added words and pieces in another order; scattered words and forms of
words that questions share stay below the least passage. Texts are compared as words without case, markup, layout and
encoding: compatibility forms and look-alike letters are folded, invisible characters and end-of-line hyphens dropped.

Defined results: NULL, empty and blank texts of documents or items match nothing; repeated documents each count; items
of equal words are searched once and reported each; of items that share most of their words each is reported that the
document repeats by half; a document of any length is searched whole; empty tables give an empty result; other columns
are not read. No shuffle. The items are broadcast in blocks of at most :data:`BLOCK_CHARS` characters, measured before
anything is collected; each block reads the documents once. Memory follows the shard and the found places.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PHRASE = 3
LEAST_SHARE = 0.5
#: Words that may stand between two found phrases of a passage, and the found words from which a passage counts.
GAP, LEAST_PASSAGE = 2, 10
SHARD_WORDS = 250_000
SAMPLE = 4
BLOCK_CHARS = 32_000_000
#: Places weighed at a time, whole documents at least.
PLACES = 2_000_000

#: Letters of other alphabets that look like these Latin ones.
LOOK_ALIKES = str.maketrans("авесһіјкмнорԛѕтухѵԝɡıοανρτυικ", "abechijkmhopqstyxvwgioavptuik")
_LOOKS = re.compile(f"[{''.join(map(chr, LOOK_ALIKES))}]")
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]{0,300}>")
_HYPHEN = re.compile(r"(?<=\w)[-\u00ad\u2010][ \t]*\r?\n[ \t]*(?=\w)")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt\"/\\])")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}--[\u0e00-\u0e7f]]", regex.V1)
_ASCII = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def word_keys(text: str) -> list[str] | list[bytes]:
    """The words of a text without case, markup, layout and encoding; as bytes if all of them are ASCII."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "-" in text or "\u00ad" in text or "\u2010" in text:
        text = _HYPHEN.sub("", text)
    if text.isascii():
        return text.encode().translate(_ASCII).split()
    text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text).casefold())
    if _LOOKS.search(text):
        text = text.translate(LOOK_ALIKES)
    return _WORD.findall(text)


def words(text: str) -> list[str]:
    """The words of a text as strings."""
    return [w if isinstance(w, str) else w.decode() for w in word_keys(text)]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of ``s`` in order, by prefix doubling over those not yet told apart. The end sorts first."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    fresh = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    rank[n] = 0
    step = 1
    while True:
        last = np.concatenate([fresh[1:], [True]])
        open_ = np.flatnonzero(~(fresh & last))
        if not len(open_):
            return order
        at = order[open_]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[open_] |= differs
        rank[at] = np.maximum.accumulate(np.where(differs, open_, 0)) + 1
        step *= 2


class Wavelet:
    """A wavelet matrix: the rank of a symbol up to a place, for many symbols and places at once."""

    def __init__(self, s: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[i][place], self.ones[i][start]
            place = np.where(one, self.zeros[i] + a, place - a)
            start = np.where(one, self.zeros[i] + b, start - b)
        return place - start


class FmIndex:
    """Counts and locates phrases in a sequence of symbols below ``size``."""

    def __init__(self, s: np.ndarray, size: int) -> None:
        n = len(s)
        order = np.concatenate([[n], suffix_array(s)])  # the empty suffix first
        self.n = n
        self.bwt = np.where(order > 0, s[order - 1] + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.bwt, minlength=size + 1))])
        self.wavelet = Wavelet(self.bwt, size + 1)
        sampled = order % SAMPLE == 0
        self.sampled, self.known = sampled, np.cumsum(sampled) - 1
        self.places = order[sampled]

    def _back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes begin with each phrase (a row of ``phrases``)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n + 1, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k] + 1
            low, high = self._back(c, low), self._back(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of the suffixes of the given rows."""
        out = np.empty(len(rows), dtype=np.int64)
        live, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            hit = self.sampled[row]
            out[live[hit]] = self.places[self.known[row[hit]]] + steps
            live, row = live[~hit], row[~hit]
            row = self._back(self.bwt[row], row)
            steps += 1
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each ``low`` up to its ``high``, and whose they are."""
    count = high - low
    whose = np.repeat(np.arange(len(low)), count)
    return np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count), whose


def _expand(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the lists ``which``, and whose they are; list k lies from ``start[k]`` to ``start[k + 1]``."""
    return _ranges(start[which], start[which + 1])


def _distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])[: len(a)]]


class Items:
    """The different items as word numbers, and their test phrases.

    Links join a phrase and an item that has it; those of phrase p are ``link_start[p]`` to ``link_start[p + 1]``. The
    places of the phrase in the item are those of the link, laid out likewise.
    """

    def __init__(self, rows: list[tuple]) -> None:
        same: dict[tuple[str, ...], list] = defaultdict(list)
        for i, t in rows:
            if i is not None and t and (w := tuple(words(t))):
                same[w].append(i)
        self.ids = list(same.values())
        self.number: dict[str | bytes, int] = {w: k + 2 for k, w in enumerate(sorted({x for w in same for x in w}))}
        self.size = len(self.number) + 2
        texts = [[self.number[x] for x in w] for w in same]
        self.number |= {w.encode(): k for w, k in self.number.items() if w.isascii()}
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.width = np.minimum(self.length, PHRASE)
        owned: dict[tuple[int, ...], dict[int, list[int]]] = {}
        for k, t in enumerate(texts):
            n = min(PHRASE, len(t))
            for j in range(len(t) - n + 1):
                owned.setdefault(tuple(t[j : j + n]), {}).setdefault(k, []).append(j)
        phrases = sorted(owned, key=len)
        self.phrases = [(a, np.array(g, dtype=np.int64)) for n in range(1, PHRASE + 1) if (g := [p for p in phrases if len(p) == n]) for a in [sum(len(p) < n for p in phrases)]]
        self.link_start = np.cumsum([0, *(len(owned[p]) for p in phrases)])
        self.link_item = np.array([k for p in phrases for k in owned[p]], dtype=np.int64)
        self.place_start = np.cumsum([0, *(len(j) for p in phrases for j in owned[p].values())])
        self.place = np.array([j for p in phrases for at in owned[p].values() for j in at], dtype=np.int64)


def occurrences(s: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Where in a sequence of word numbers which test phrase begins, by indexes over its parts.

    Words that no item has (1) can't be part of a phrase, so that each run of them takes one place in the index.
    """
    kept = np.flatnonzero(np.concatenate([[True], (s[1:] != 1) | (s[:-1] != 1)]))
    short = s[kept]
    step = -(-len(short) // max(1, round(len(short) / SHARD_WORDS)))
    at, which = [], []
    for begin in range(0, len(short), step):
        index = FmIndex(short[begin : begin + step + PHRASE - 1], items.size)
        for first, phrases in items.phrases:
            low, high = index.search(phrases)
            rows, phrase = _ranges(low, high)
            place = index.locate(rows)
            own = place < step
            at.append(kept[begin + place[own]])
            which.append(first + phrase[own])
    return np.concatenate(at), np.concatenate(which)


def passages(doc: np.ndarray, at: np.ndarray, which: np.ndarray, items: Items) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """The items that documents repeat: (document, item, words repeated, passages). ``at``: places, ascending by document."""
    link, whose = _expand(items.link_start, which)
    item, doc, at = items.link_item[link], doc[whose], at[whose]
    order = np.argsort((((doc - doc[0]) * len(items.length) + item) << 32) + at, kind="stable")
    link, item, doc, at = link[order], item[order], doc[order], at[order]
    width = items.width[item]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
    space = np.concatenate([[0], at[1:] - at[:-1] - width[:-1]])
    fresh = other | (space > GAP)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at)) - 1
    found = np.add.reduceat(np.where(fresh, width, width + np.minimum(space, 0)), begin)
    half = np.ceil(LEAST_SHARE * items.length).astype(np.int64)
    counts = found >= np.minimum(LEAST_PASSAGE, half[item[begin]])
    pair = np.cumsum(other) - 1
    inside = counts[np.cumsum(fresh) - 1]
    if not inside.any():
        return []
    links = _distinct((pair[inside] << 32) + link[inside])
    place, of = _expand(items.place_start, links & 0xFFFFFFFF)
    said = _distinct(np.concatenate([(links[of] >> 32 << 32) + items.place[place] + k for k in range(PHRASE)]))
    head = np.flatnonzero(other)
    said = said[(said & 0xFFFFFFFF) < items.length[item[head]][said >> 32]]
    repeated = np.bincount(said >> 32, minlength=len(head))
    leaks = repeated >= half[item[head]]
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in np.flatnonzero(counts & leaks[pair[begin]]):
        spans[int(pair[begin[k]])].append((int(at[begin[k]]), int(at[end[k]] + width[end[k]])))
    return [(int(doc[head[p]]), int(item[head[p]]), int(repeated[p]), spans[p]) for p in np.flatnonzero(leaks).tolist()]


def shard_leaks(docs: list[np.ndarray], items: Items) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """The leaks of some documents: (number of the document, item, words repeated, passages)."""
    if not docs or not len(items.place):
        return []
    start = np.cumsum([0, *(len(d) + 1 for d in docs)])
    s = np.zeros(start[-1], dtype=np.int64)
    for d, a in zip(docs, start):
        s[a : a + len(d)] = d
    at, which = occurrences(s, items)
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    doc = np.searchsorted(start, at, "right") - 1
    weight = np.cumsum(items.link_start[which + 1] - items.link_start[which])
    out, a = [], 0
    while a < len(at):  # as many places at a time, and the whole of the last document
        b = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + PLACES, "right"))
        b = int(np.searchsorted(doc, doc[max(a, b - 1)], "right"))
        out += passages(doc[a:b], at[a:b] - start[doc[a:b]], which[a:b], items)
        a = b
    return out


def find_leaks(df: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``id_col``, ``item_id``, the item's ``words`` and those ``repeated``, and the passages' word ``spans``."""
    asked = items.select(F.col(item_id).alias("__item"), F.col(item_text).cast("string").alias("__text")).where("__item IS NOT NULL AND __text <> ''")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("__text"))).first()[0] or 0) // block_chars))
    parts = [_search(df, id_col, text_col, asked.where(F.pmod(F.xxhash64("__text"), F.lit(blocks)) == k) if blocks > 1 else asked, item_id) for k in range(blocks)]
    return reduce(DataFrame.unionAll, parts)


def _search(df: DataFrame, id_col: str, text_col: str, asked: DataFrame, item_id: str) -> DataFrame:
    """The leaks of one block of items, whose size has been checked."""
    known = df.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in asked.collect()]))
    item_type = asked.schema["__item"].dataType
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(item_id, item_type), T.StructField("words", T.IntegerType()), T.StructField("repeated", T.IntegerType()), T.StructField("spans", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    item_kind = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        get = items.number.get
        held: list[np.ndarray] = []
        ids: list[pa.Scalar] = []
        size = 0

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            found = [(d, i, k, n, s) for d, k, n, s in shard_leaks(held, items) for i in items.ids[k]]
            columns = [pa.array([ids[d].as_py() for d, *_ in found], kind), pa.array([i for _, i, *_ in found], item_kind), pa.array([int(items.length[k]) for _, _, k, *_ in found], pa.int32())]
            columns += [pa.array([n for *_, n, _ in found], pa.int32()), pa.array([[{"start": a, "end": b} for a, b in s] for *_, s in found], spans)]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, item_id, "words", "repeated", "spans"])

        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):
                if (text := t.as_py()) and (w := word_keys(text)):
                    held.append(np.fromiter((get(x, 1) for x in w), np.int64, len(w)))
                    ids.append(d)
                    size += len(w)
                    if size >= SHARD_WORDS:
                        yield flush(b.column(0).type)
                        held, ids, size = [], [], 0
            kind = b.column(0).type
        if held:
            yield flush(kind)

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def removal_spans(leaks: DataFrame, id_col: str) -> DataFrame:
    """The spans of all leaks of a document, overlapping ones merged: ``id_col`` and ``spans``."""
    one = leaks.select(id_col, F.explode("spans").alias("s")).groupBy(id_col).agg(F.array_sort(F.collect_set("s")).alias("s"))
    start = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")

    def add(acc, x):  # noqa: ANN001, ANN202
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= x["start"]), wider).otherwise(F.concat(acc, F.array(x)))

    return one.select(id_col, F.aggregate("s", start, add).alias("spans"))
