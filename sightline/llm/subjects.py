"""Subject areas of documents, by one-versus-rest linear classifiers on hashed word n-grams.

Sentences are classified, then counted: a document has an area if a large enough part of its sentences treats it. The
classifiers are logistic, one per area, on hashed single words and word pairs (for scripts without blanks: on letter
groups). They learn from weak labels: each sentence of a labelled document first stands for all of that document's
areas; then, in rounds, only for those that the classifiers trained so far see in it. A document's labels are those
that at least half of its annotators gave; unknown names are ignored. The share that decides is calibrated per area on
the labelled documents, drawn towards the share that is best for all areas together where an area has few labels.

The fit takes at most ``max_labelled`` labelled documents and always ``unlabelled`` others, for which a first model's
answers stand; both are the first in order of a hash of their ids. Of each such document at most :data:`FIT_SENTENCES`
sentences take part, those that come first in order of a hash, however long it is, so that the sample has a bound; they
are cut out where the documents are. Everything else covers all rows and all sentences. A model is kept in the session
for the same sample. It has a fixed size and is broadcast; classifying is one pass without a shuffle.

Defined results: NULL, empty and blank texts, and texts without an area, have no row; repeated labels of one annotator
count once; with no labels at all there are no rows; repeated documents each have rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 16
MAX_LABELLED, UNLABELLED, FIT_SENTENCES = 3000, 1500, 64
#: A sentence treats the area whose classifier gives it most, if that is at least this.
TREATS = 0.35
ROUNDS = 3
#: The share to begin with: a quarter, less the sentences that a classifier misses; it weighs as much as so many labels.
USUAL_SHARE, USUAL_WEIGHT = 0.18, 300
CHUNK_CHARS = 1_000_000

_MARKUP = re.compile(r"<[/!?]?[A-Za-z][^<>]{0,200}>|&[#a-z0-9]{2,8};")
_ENDS = r"[.!?]+(?=\s|$)|[\r\n]+|\s-\s|[。！？]"
_END = re.compile(_ENDS)
_ASCII_TOKEN, _TOKEN = re.compile(f"[a-z]+|{_ENDS}"), regex.compile(rf"[\p{{L}}\p{{M}}]+|{_ENDS}")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = re.compile(r"[^\W\d_]")
_UNSPACED = re.compile("[฀-๿]")
_BROKEN = re.compile("[ÂÃàâ][\u0080-ÿŒ-™]")


def mend(text: str) -> str:
    """The text with bytes that were read in the wrong encoding put right, without markup, in compatibility form."""
    for _ in range(2):
        if not _BROKEN.search(text):
            break
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            text = re.sub("[Â-ô][\u0080-¿]{1,3}", lambda m: _again(m[0]), text)
            break
    text = _MARKUP.sub("\n", text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _again(piece: str) -> str:
    try:
        return piece.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return piece


def sentences(text: str) -> list[str]:
    """The sentences of a text; in scripts that put blanks between sentences only, the parts between blanks."""
    out, text = [], mend(text).casefold()
    if not _UNSPACED.search(text):
        return [part for part in _END.split(text) if _LETTER.search(part)]
    for part in _END.split(text):
        if _UNSPACED.search(part):
            held = ""
            for piece in part.split():
                held = f"{held} {piece}"
                if len(_UNSPACED.findall(piece)) >= 8:
                    out.append(held)
                    held = ""
            if held and out:
                out[-1] += held
            elif held:
                out.append(held)
        elif _LETTER.search(part):
            out.append(part)
    return out


#: What a token is, beside the hash of a word: a word of one letter, and the end of a sentence.
_SHORT, _STOP = -1, -2
_HASHES: dict[str, int] = {}


def _hash(s: str) -> int:
    """The code of a token."""
    h = _HASHES.get(s)
    if h is None:
        if len(_HASHES) > 500_000:
            _HASHES.clear()
        if not (s[0].isalpha() or unicodedata.category(s[0])[0] == "M"):
            h = _STOP
        else:
            h = zlib.crc32(s.encode("utf-8", "replace")) if len(s) > 1 else _SHORT
        _HASHES[s] = h
    return h


_GROUPS: dict[str, list[int]] = {}


def _groups(w: str) -> list[int]:
    """The buckets of a word's groups of three and five letters."""
    g = _GROUPS.get(w)
    if g is None:
        if len(_GROUPS) > 100_000:
            _GROUPS.clear()
        g = _GROUPS[w] = [zlib.crc32(w[i : i + n].encode("utf-8", "replace")) % BUCKETS for n in (3, 5) for i in range(max(1, len(w) - n + 1))]
    return g


def letter_groups(sentence: str) -> list[int]:
    """The buckets of the words and pairs of words of a sentence in which words of unspaced scripts count by letter groups."""
    out, last = [], 0
    for w in _WORD.findall(sentence):
        if "฀" <= w[0] <= "๿":
            out += _groups(w)
            last = 0
        elif len(w) > 1:
            h = zlib.crc32(w.encode("utf-8", "replace"))
            out.append(h % BUCKETS)
            if last:
                out.append((last * 0x9E3779B1 ^ h) // 128 % BUCKETS)
            last = h
    return out


class Matrix:
    """Sparse rows of ones, each row scaled to length one."""

    def __init__(self, n: int, row: np.ndarray, column: np.ndarray) -> None:
        """``row`` and ``column``: where the ones stand, in any order, repeats allowed."""
        at = np.sort(row.astype(np.int64) * BUCKETS + column)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]
        self.n, self.row, self.column = n, (at // BUCKETS).astype(np.int32), (at % BUCKETS).astype(np.int32)
        count = np.bincount(self.row, minlength=n)
        self.filled = np.flatnonzero(count)
        self.begin = (np.cumsum(count) - count)[self.filled]
        self.value = np.repeat((1 / np.sqrt(np.maximum(count, 1))).astype(np.float32), count)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """The product with weights of shape (column, class)."""
        out = np.zeros((self.n, w.shape[1]), dtype=np.float32)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(w[self.column], self.begin, axis=0)
            out[self.filled] *= self.value[self.begin][:, None]
        return out


def read(texts: list[str]) -> tuple[Matrix, np.ndarray]:
    """The features of all sentences of some texts, and whose they are: words and pairs of neighbouring words, hashed.

    The tokens of all texts are one sequence of codes; sentences and pairs come out of it at once.
    """
    tokens: list[str] = []
    ends, apart = [], []
    for k, t in enumerate(texts):
        t = mend(t).casefold()
        if _UNSPACED.search(t):
            apart += [(k, letter_groups(s)) for s in sentences(t)]
        else:
            tokens += _ASCII_TOKEN.findall(t) if t.isascii() else _TOKEN.findall(t)
        ends.append(len(tokens))
    get = _HASHES.get
    code = np.fromiter((_hash(t) if (h := get(t)) is None else h for t in tokens), dtype=np.int64, count=len(tokens))
    doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    part = np.cumsum(code == _STOP) + doc  # a number for each stretch between ends
    word = code != _STOP
    code, doc, part = code[word], doc[word], part[word]
    fresh = np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]
    sentence, of = np.cumsum(fresh) - 1, doc[fresh]
    long = code >= 0
    h, sentence = code[long].astype(np.uint64), sentence[long]
    pair = np.flatnonzero(sentence[1:] == sentence[:-1]) + 1
    both = ((h[pair - 1] * np.uint64(0x9E3779B1)) ^ h[pair]) // np.uint64(128) % np.uint64(BUCKETS)
    n = len(of)
    row = np.concatenate([sentence, sentence[pair], np.repeat(n + np.arange(len(apart)), [len(f) for _, f in apart]).astype(np.int64)])
    column = np.concatenate([(h % np.uint64(BUCKETS)).astype(np.int64), both.astype(np.int64), np.array([x for _, f in apart for x in f], dtype=np.int64)])
    return Matrix(n + len(apart), row, column), np.concatenate([of, np.array([k for k, _ in apart], dtype=np.int64)])


def fit_logistic(x: Matrix, y: np.ndarray, weight: np.ndarray, steps: int = 35, start: tuple[np.ndarray, np.ndarray] | None = None, ridge: float = 2e-5, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """The weights and biases of one classifier per column of ``y`` (values from 0 to 1), by scaled gradient steps."""
    classes = y.shape[1]
    used, column = np.unique(x.column, return_inverse=True)
    own = copy(x)
    own.column = column.astype(np.int32)
    by = np.argsort(column, kind="stable")
    rows, first = x.row[by], np.searchsorted(column[by], np.arange(len(used)))
    scale = np.zeros((x.n, 1), dtype=np.float32)
    scale[x.filled, 0] = x.value[x.begin]
    w, b = (start[0][used].astype(np.float32), start[1].copy()) if start else (np.zeros((len(used), classes), np.float32), np.full(classes, -2.0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    share = (weight / weight.sum())[:, None]
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(own.dot(w) + b, -30, 30)))
        error = (p - y) * share
        g = np.add.reduceat((error * scale).astype(np.float32)[rows], first, axis=0) + ridge * w
        gb = error.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= (rate / c1 * m / (np.sqrt(v / c2) + 1e-9)).astype(np.float32)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    full = np.zeros((BUCKETS, classes), dtype=np.float32)
    full[used] = w
    return full, b


@dataclass
class Model:
    """The classifiers and the least share of sentences for each area."""

    names: list[str]
    w: np.ndarray
    b: np.ndarray
    share: np.ndarray

    def treated(self, x: Matrix) -> np.ndarray:
        """The area of each sentence, or -1."""
        if not x.n:
            return np.zeros(0, dtype=np.int64)
        z = x.dot(self.w) + self.b
        best = z.argmax(axis=1)
        return np.where(z[np.arange(x.n), best] >= np.log(TREATS / (1 - TREATS)), best, -1)

    def shares(self, texts: list[str]) -> np.ndarray:
        """The part of each text's sentences that treats each area."""
        x, of = read(texts)
        return self.counted(x, of, len(texts))

    def counted(self, x: Matrix, of: np.ndarray, n: int) -> np.ndarray:
        got = self.treated(x)
        hits = np.zeros((n, len(self.names)))
        np.add.at(hits, (of[got >= 0], got[got >= 0]), 1)
        return hits / np.maximum(np.bincount(of, minlength=n), 1)[:, None]


def vote(labels: list[tuple[object, str | None, str | None]], names: list[str]) -> dict[object, set[int]]:
    """For each labelled document the areas that at least half of its annotators gave."""
    number = {n.strip().lower(): i for i, n in enumerate(names)}
    given: dict[object, dict[str | None, set[int]]] = defaultdict(lambda: defaultdict(set))
    for doc, subject, annotator in labels:
        k = number.get(re.sub(r"[\s-]+", "_", subject.strip().lower())) if subject is not None else None
        if subject is None or k is not None:
            given[doc][annotator] |= set() if k is None else {k}
    return {d: {k for k in set().union(*by.values()) if 2 * sum(k in v for v in by.values()) >= len(by)} for d, by in given.items()}


def fit(texts: list[str], areas: list[set[int]], names: list[str], more: list[str] | None = None) -> Model | None:
    """Fit the classifiers and calibrate the shares on labelled texts.

    ``more``: texts without labels. A first model's answers stand for their labels in a second fit.
    """
    if not any(areas) or not read(texts)[0].n:
        return None
    known, start = len(texts), None
    if more:
        first = fit(texts, areas, names)
        share, start = first.shares(more), (first.w, first.b)
        texts = [*texts, *more]
        areas = [*areas, *({int(k) for k in np.flatnonzero(s >= np.maximum(first.share, 0.2))} for s in share)]
    x, of = read(texts)
    count = np.bincount(of, minlength=len(texts))
    allowed = np.zeros((len(texts), len(names)))
    for d, a in enumerate(areas):
        allowed[d, list(a)] = 1
    may = allowed[of]
    y = may / np.maximum(may.sum(axis=1, keepdims=True), 1)
    weight = 1 / np.sqrt(np.maximum(count, 1))[of]
    for turn in range(ROUNDS):
        w, b = start = fit_logistic(x, y, weight, 20 if start else 35, start)
        if turn == ROUNDS - 1:
            break
        z = x.dot(w) + b
        p = 1 / (1 + np.exp(-z))
        inside = np.where(may > 0, p, 0)
        best, prior = inside.argmax(axis=1), (weight[:, None] * y).sum(axis=0) / weight.sum()
        level = (prior + (1 - prior) * (0.15, 0.35)[min(turn, 1)])[best]
        sure = (inside.max(axis=1) >= level)[:, None] & (np.arange(len(names)) == best[:, None])
        # what the classifiers see clearly although no annotator named it says nothing either way
        y = np.where(sure, 1.0, np.where((may == 0) & (p > 0.7), p, 0.0))
    model = Model(names, w, b, np.full(len(names), 0.25))
    model.share = calibrate(model.counted(x, of, len(texts))[:known], allowed[:known] > 0)
    return model


def calibrate(share: np.ndarray, truth: np.ndarray, low: float = 0.12, high: float = 0.32, pull: float = 30.0) -> np.ndarray:
    """The least share of each area: the middle of the best values for F1, drawn towards the best for all areas."""
    grid = np.arange(low, high + 1e-9, 0.005)

    def best(s: np.ndarray, t: np.ndarray) -> float:
        given = s[..., None] >= grid
        hit = (given & t[..., None]).reshape(-1, len(grid)).sum(axis=0)
        f1 = 2 * hit / np.maximum(given.reshape(-1, len(grid)).sum(axis=0) + t.sum(), 1)
        return float(np.median(grid[f1 >= f1.max() - 1e-3]))

    own = np.array([best(share[:, k], truth[:, k]) for k in range(share.shape[1])])
    n = truth.sum(axis=0)
    whole = (best(share, truth) * n.sum() + USUAL_SHARE * USUAL_WEIGHT) / (n.sum() + USUAL_WEIGHT)
    return (own * n + whole * pull) / (n + pull)


def excerpt(text: str, most: int = FIT_SENTENCES) -> str:
    """At most so many sentences of a text, those first in order of a hash, one a line."""
    found = sentences(text)
    if len(found) > most:
        found = [found[i] for i in sorted(sorted(range(len(found)), key=lambda i: (zlib.crc32(found[i].encode("utf-8", "replace")), i))[:most])]
    return "\n".join(found)


_MODELS: dict[str, Model | None] = {}


def train(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED, unlabelled: int = UNLABELLED) -> Model | None:
    """Fit on at most ``max_labelled`` labelled documents; labels has doc_id, subject and annotator, subjects subject."""
    names = sorted(r[0] for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())
    given = labels.select(F.col("doc_id").alias("id"), "subject", "annotator").where("id IS NOT NULL").distinct()
    keys = given.select("id").distinct()
    chosen = keys.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text <> ''")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([excerpt(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    def taken(df: DataFrame) -> list[tuple]:
        return sorted(tuple(r) for r in df.mapInArrow(cut_out, text.schema).collect())

    rows = taken(text.join(F.broadcast(chosen), "id"))
    votes = [tuple(r) for r in given.join(F.broadcast(chosen), "id").collect()]
    areas = vote(votes, names)
    if not rows or not names:
        return None
    rest = taken(text.join(keys, "id", "left_anti").orderBy(F.xxhash64("id"), "id", "text").limit(unlabelled)) if unlabelled else []
    sample = (tuple(rows), tuple(rest), tuple(sorted(votes, key=repr)), tuple(names))
    key = hashlib.sha256(repr(sample).encode("utf-8", "replace")).hexdigest()
    if key not in _MODELS:
        if len(_MODELS) > 3:
            _MODELS.clear()
        _MODELS[key] = fit([t for _, t in rows], [areas.get(i, set()) for i, _ in rows], names, [t for _, t in rest])
    return _MODELS[key]


def classify(docs: DataFrame, id_col: str, text_col: str, model: Model | None) -> DataFrame:
    """``id_col``, ``subject`` and ``share``: a row for each area of each document."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(Model(model.names, model.w.astype(np.float32), model.b.astype(np.float32), model.share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts, rows, size = [], [], 0
            last = b.num_rows - 1
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    texts.append(t)
                    rows.append(i)
                    size += len(t)
                if texts and (size >= CHUNK_CHARS or i == last):
                    share = m.shares(texts)
                    d, k = np.nonzero((share >= m.share) & (share > 0))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(rows, dtype=np.int64)[d])), pa.array([m.names[j] for j in k], pa.string()), pa.array(share[d, k])], names=[id_col, "subject", "share"])
                    texts, rows, size = [], [], 0

    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
