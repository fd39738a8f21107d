"""Flat, linked rows out of deeply nested JSON records, by vectorised structural indexing.

A chunk of texts is one byte buffer. Bitmaps of quotes, escapes, brackets and delimiters are built over it; nesting
depth is a prefix sum over the brackets; every token gets the container it stands in by a sort on (record, depth,
place); a position in an array is a prefix sum over that array's commas. From these spans, each object that is an
element of an array becomes one row with its path (``node``) and the path of the nearest object of the same kind around
it (``parent``, '' if there is none). Strings that hold the JSON text of an object or array are indexed in a further
round and count as that value, at any depth.

The check of the grammar is part of the indexing: a text that is not one complete, valid JSON value gives no rows, and
neither do NULL and empty texts. Of two members of one object with the same name the last holds. Nulls in arrays keep
their position and have no row. Repeated input rows give repeated output rows. An empty input gives an empty result;
columns other than the two named are not read. The work is one pass without a shuffle; memory follows the chunk
(:data:`CHUNK_BYTES`) or the longest single text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 2_000_000

_OBJ, _END_OBJ, _ARR, _END_ARR, _COLON, _COMMA, _STR, _VAL, _NONE = range(9)
_KIND = np.full(256, _NONE, dtype=np.int8)
for _byte, _k in zip(b"{}[]:,", range(6)):
    _KIND[_byte] = _k
_SPACE = np.isin(np.arange(256), list(b" \t\n\r"))
_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
_ESCAPES = np.isin(np.arange(256), list(b'"\\/bfnrtu'))
_WRONG_SCALAR = re.compile(rb"^(?!(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$).+$", re.M)


class Index:
    """The structural index of several texts: tokens with their record, kind, container and position, and validity."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buf = b"\n".join(texts) + b"\n" + b" " * 8
        b = self.b = np.frombuffer(self.buf, dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n, self.start = len(texts), np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        self.bad = np.zeros(self.n, dtype=bool)
        opens, closes, escaping = self._strings(b)
        inside = np.zeros(len(b) + 1, dtype=np.int8)
        inside[opens] += 1
        inside[closes] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        self._escapes(b, inside, escaping)
        self._tokens(b, inside, opens, closes)
        self._containers()
        self._grammar()

    def record(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def _strings(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slash = np.flatnonzero(b == 92)
        escaped = np.zeros(len(b) + 1, dtype=bool)
        if len(slash):
            fresh = np.concatenate([[True], np.diff(slash) != 1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(slash)), 0))
            slash = slash[(np.arange(len(slash)) - first) % 2 == 0]
            escaped[slash + 1] = True
        quotes = np.flatnonzero((b == 34) & ~escaped[:-1])
        of = self.record(quotes)
        count = np.bincount(of, minlength=self.n)
        self.bad |= count % 2 == 1
        keep = ~self.bad[of]
        quotes, of = quotes[keep], of[keep]
        return quotes[::2], quotes[1::2], slash

    def _escapes(self, b: np.ndarray, inside: np.ndarray, escaping: np.ndarray) -> None:
        at = escaping[inside[escaping]] if len(escaping) else escaping
        wrong = [at[~_ESCAPES[b[at + 1]]]]
        u = at[b[at + 1] == 117]
        wrong.append(u[~(_HEX[b[u + 2]] & _HEX[b[u + 3]] & _HEX[b[u + 4]] & _HEX[b[u + 5]])])
        wrong.append(np.flatnonzero(inside & (b < 32)))
        for w in wrong:
            self.bad[self.record(w)] = True

    def _tokens(self, b: np.ndarray, inside: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> None:
        plain = ~inside & (_KIND[b] == _NONE) & ~_SPACE[b] & (b != 34)
        starts = np.flatnonzero(plain & ~np.concatenate([[False], plain[:-1]]))
        after = np.flatnonzero(~plain & np.concatenate([[False], plain[:-1]]))
        kept = np.flatnonzero(plain | np.concatenate([[False], plain[:-1]]))
        wrong = [m.start() for m in _WRONG_SCALAR.finditer(np.where(plain, b, 10)[kept].tobytes())]
        self.bad[self.record(kept[wrong])] = True
        marks = np.flatnonzero(~inside & (_KIND[b] != _NONE))
        at = np.concatenate([marks, opens, starts])
        kind = np.concatenate([_KIND[b[marks]], np.full(len(opens), _STR, np.int8), np.full(len(starts), _VAL, np.int8)])
        end = np.concatenate([marks + 1, closes, after])
        order = np.argsort(at, kind="stable")
        at, kind, end = at[order], kind[order], end[order]
        rec = self.record(at)
        keep = ~self.bad[rec]
        self.at, self.kind, self.end, self.rec = at[keep], kind[keep], end[keep], rec[keep]

    def _containers(self) -> None:
        kind, rec, n = self.kind, self.rec, len(self.at)
        opening, closing = (kind == _OBJ) | (kind == _ARR), (kind == _END_OBJ) | (kind == _END_ARR)
        step = opening.astype(np.int64) - closing
        total = np.cumsum(step)
        first = np.concatenate([[True], rec[1:] != rec[:-1]]) if n else np.zeros(0, bool)
        base = (total - step)[np.maximum.accumulate(np.where(first, np.arange(n), 0))] if n else total
        after, level = total - base, total - base - step
        self.bad[rec[(after < 0) | (closing & (level <= 0))]] = True
        last = np.concatenate([first[1:], [True]]) if n else first
        self.bad[rec[last & (after != 0)]] = True
        self.bad |= np.bincount(rec, minlength=self.n) == 0
        level = np.maximum(level, 0)
        own = np.flatnonzero(opening)
        token = np.concatenate([np.arange(n), own])
        depth = np.concatenate([level, level[own] + 1])
        defines = np.concatenate([np.zeros(n, bool), np.ones(len(own), bool)])
        top = int(depth.max(initial=0)) + 1
        group = np.concatenate([rec, rec[own]]) * top + depth
        order = np.argsort(group * max(n, 1) + token, kind="stable")
        token, group, defines = token[order], group[order], defines[order]
        latest = np.maximum.accumulate(np.where(defines, np.arange(len(token)), -1))
        known = (latest >= 0) & (group[latest] == group)
        commas = np.cumsum((kind[token] == _COMMA) & ~defines)
        member = np.flatnonzero(~defines)
        self.inside = np.empty(n, dtype=np.int64)
        self.place = np.empty(n, dtype=np.int64)
        self.inside[token[member]] = np.where(known[member], token[latest[member]], -1)
        self.place[token[member]] = commas[member] - commas[latest[member]]
        self.opening, self.closing, self.first, self.level = opening, closing, first, level

    def _grammar(self) -> None:
        kind, n = self.kind, len(self.kind)
        prev = np.concatenate([[_NONE], kind[:-1]])[:n]
        prev = np.where(self.first, _NONE, prev)
        held = np.where(self.inside >= 0, kind[self.inside] if n else 0, _NONE)
        in_obj, in_arr, at_root = held == _OBJ, held == _ARR, held == _NONE
        starts = self.opening | (kind == _STR) | (kind == _VAL)
        self.is_key = in_obj & (kind == _STR) & ((prev == _OBJ) | (prev == _COMMA))
        key_before = np.concatenate([[False], self.is_key[:-1]])[:n]
        ended = (prev == _END_OBJ) | (prev == _END_ARR) | (prev == _VAL) | ((prev == _STR) & ~key_before)
        good = np.zeros(n, dtype=bool)
        good |= at_root & starts & self.first
        good |= self.is_key | (in_obj & starts & (prev == _COLON))
        good |= in_obj & (kind == _COLON) & key_before
        good |= in_arr & starts & ((prev == _ARR) | (prev == _COMMA))
        good |= (in_obj | in_arr) & (kind == _COMMA) & ended
        good |= in_obj & (kind == _END_OBJ) & ((prev == _OBJ) | ended)
        good |= in_arr & (kind == _END_ARR) & ((prev == _ARR) | ended)
        self.bad[self.rec[~good]] = True

    def text(self, token: int) -> str:
        """The characters of a string token."""
        raw = self.buf[self.at[token] + 1 : self.end[token]]
        return json.loads(b'"' + raw + b'"') if b"\\" in raw else raw.decode("utf-8", "replace")

    def overridden(self) -> set[int]:
        """The value tokens of members whose name comes again later in their object."""
        keys = np.flatnonzero(self.is_key & ~self.bad[self.rec])
        if len(keys) < 2:
            return set()
        at, length = self.at[keys] + 1, self.end[keys] - self.at[keys] - 1
        sign = self.inside[keys].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64)
        for i in range(8):
            for place in (at + i, at + np.maximum(length - 1 - i, 0)):
                byte = np.where(i < length, self.b[np.minimum(place, len(self.b) - 1)], 0).astype(np.uint64)
                sign = (sign ^ byte) * np.uint64(0x100000001B3)
        _, inverse, count = np.unique(sign, return_inverse=True, return_counts=True)
        escaped = np.zeros(len(keys), bool)
        slash = np.flatnonzero(self.b == 92)
        if len(slash):
            escaped = np.searchsorted(slash, self.end[keys]) > np.searchsorted(slash, at)
        risky = set(self.inside[keys[(count[inverse] > 1) | escaped]].tolist())
        out, seen = set(), {}
        if risky:
            for k in keys[np.isin(self.inside[keys], list(risky))]:
                name = (int(self.inside[k]), self.text(k))
                if name in seen:
                    out.add(seen[name])
                seen[name] = int(k) + 2
        return out


@dataclass
class _Roots:
    """Where the values of texts stand: the rows they belong to, their paths, the cases around them, and what they are there."""

    row: np.ndarray
    path: pa.Array
    parent: pa.Array
    element: np.ndarray
    lone: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[int]) -> _Roots:
        row = np.fromiter(rows, dtype=np.int64)
        none, blank = np.zeros(len(row), dtype=bool), pa.array([""] * len(row), pa.large_string())
        return cls(row, blank, blank, none, none)


def _names(ix: Index, keys: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different names among key tokens, and the number of each token's name."""
    at, length = ix.at[keys] + 1, ix.end[keys] - ix.at[keys] - 1
    slash = np.flatnonzero(ix.b == 92)
    escaped = np.searchsorted(slash, ix.end[keys]) > np.searchsorted(slash, at)
    short = (length <= 16) & ~escaped
    code = np.empty(len(keys), dtype=np.int64)
    width = np.arange(16)
    held = np.where(width < length[short, None], ix.b[np.minimum(at[short, None] + width, len(ix.b) - 1)], 0).astype(np.uint8)
    words = np.ascontiguousarray(held).view(np.uint64)
    # names of up to 16 bytes without NULs are told apart by these two numbers
    order = np.lexsort((words[:, 1], words[:, 0]))
    words = words[order]
    fresh = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])[: len(words)]
    number = np.cumsum(fresh) - 1
    code[np.flatnonzero(short)[order]] = number
    names = [ix.text(k) for k in keys[np.flatnonzero(short)[order[fresh]]].tolist()]
    known: dict[str, int] = {}
    for i in np.flatnonzero(~short).tolist():
        name = ix.text(int(keys[i]))
        if name not in known:
            known[name] = len(names)
            names.append(name)
        code[i] = known[name]
    return pa.array(names, pa.large_string()), code


def _text(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


def _index_round(texts: list[bytes], roots: _Roots, lone: frozenset[str], emit: Callable[[np.ndarray, pa.Array, pa.Array, Index, np.ndarray], None]) -> tuple[list[bytes], _Roots | None]:
    """Emit the cases of the texts, one level of nesting after another; give the texts embedded in them and their places."""
    ix = Index(texts)
    values = np.flatnonzero(~ix.bad[ix.rec] & (ix.opening | ((ix.kind == _STR) & ~ix.is_key & np.isin(ix.b[np.minimum(ix.at + 1, len(ix.b) - 1)], list(b"{[ \\")))))
    dead = np.zeros(len(ix.kind), dtype=bool)
    dead[list(ix.overridden())] = True
    level, slot = ix.level[values], np.full(len(ix.kind), -1)
    inner: list[tuple[list[bytes], _Roots]] = []
    above: tuple[pa.Array, pa.Array] | None = None
    for depth in range(int(level.max(initial=-1)) + 1):
        own = values[level == depth]
        own = own[~dead[own]]
        if depth:
            own = own[slot[ix.inside[own]] >= 0]
        if not len(own):
            break
        if depth == 0:
            rec = pa.array(ix.rec[own])
            path, case = roots.path.take(rec), roots.parent.take(rec)
            element, single = roots.element[ix.rec[own]], roots.lone[ix.rec[own]]
        else:
            base = pa.array(slot[ix.inside[own]])
            path, case = above[0].take(base), above[1].take(base)
            element = ix.kind[ix.inside[own]] == _ARR
            single = np.zeros(len(own), dtype=bool)
            member = np.flatnonzero(~element)
            names, code = _names(ix, own[member] - 2)
            single[member] = np.isin(code, [i for i, n in enumerate(names.to_pylist()) if n in lone])
            last = np.zeros(len(own), dtype=np.int64)
            last[member] = code
            index = pc.binary_join_element_wise(path, _text("["), pa.array(ix.place[own]).cast(pa.large_string()), _text("]"), _text(""))
            name = names.take(pa.array(last)) if len(names) else pa.nulls(len(own), pa.large_string())
            below = pc.if_else(pc.equal(path, _text("")), name, pc.binary_join_element_wise(path, name, _text(".")))
            path = pc.if_else(pa.array(element), index, below)
        text = ix.kind[own] == _STR
        if text.any():
            some = np.flatnonzero(text)
            found = [ix.text(t).strip(" \t\n\r") for t in own[some].tolist()]
            good = [i for i, v in enumerate(found) if v[:1] in ("{", "[") and v[-1:] in ("}", "]")]
            some = some[good]
            at = pa.array(some)
            inner.append(([found[i].encode("utf-8", "replace") for i in good], _Roots(roots.row[ix.rec[own[some]]], path.take(at), case.take(at), element[some], single[some])))
        cases = (ix.kind[own] == _OBJ) & (element | single)
        if (cases & ~element).any():
            path = pc.if_else(pa.array(cases & ~element), pc.binary_join_element_wise(path, _text("[0]"), _text("")), path)
        hit = pa.array(np.flatnonzero(cases))
        emit(roots.row[ix.rec[own[cases]]], path.take(hit), case.take(hit), ix, own[cases])
        above = path, pc.if_else(pa.array(cases), path, case)
        slot[own[~text]] = np.flatnonzero(~text)
    texts = [t for part, _ in inner for t in part]
    if not texts:
        return [], None
    parts = [r for _, r in inner]
    join = lambda k: pa.concat_arrays([getattr(r, k) for r in parts])
    return texts, _Roots(np.concatenate([r.row for r in parts]), join("path"), join("parent"), np.concatenate([r.element for r in parts]), np.concatenate([r.lone for r in parts]))


def _chunks(column: pa.Array) -> Iterator[tuple[list[bytes], list[int]]]:
    """The non-empty texts of a column in chunks of about CHUNK_BYTES, with their rows."""
    texts, rows, size = [], [], 0
    for i, v in enumerate(column.cast(pa.large_binary()).to_pylist()):
        if v:
            texts.append(v)
            rows.append(i)
            size += len(v)
            if size >= CHUNK_BYTES:
                yield texts, rows
                texts, rows, size = [], [], 0
    if texts:
        yield texts, rows


def nested_rows(texts: list[bytes], rows: Iterable[int], lone: frozenset[str], with_record: bool = False) -> dict[str, list | np.ndarray | pa.Array]:
    """Rows of one chunk: for each case the input row, node, parent and, if asked for, the object's JSON text."""
    row: list[np.ndarray] = []
    node, parent, record = [], [], []

    def emit(of: np.ndarray, nodes: pa.Array, parents: pa.Array, ix: Index, tokens: np.ndarray) -> None:
        row.append(of)
        node.append(nodes)
        parent.append(parents)
        if with_record:
            ends = np.zeros(len(ix.kind), dtype=np.int64)
            closers = np.flatnonzero(ix.closing)
            ends[ix.inside[closers]] = ix.end[closers]
            record.extend(ix.buf[a:b].decode("utf-8", "replace") for a, b in zip(ix.at[tokens].tolist(), ends[tokens].tolist()))

    roots = _Roots.of(rows)
    # a text that is one string may itself be the JSON text of an object or array; the index treats it as any value
    while texts:
        texts, roots = _index_round(texts, roots, lone, emit)
    strings = lambda parts: pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    return {"row": np.concatenate(row) if row else np.zeros(0, np.int64), "node": strings(node), "parent": strings(parent), "record": record}


def flatten_json(df: DataFrame, id_col: str, json_col: str, lone_fields: Iterable[str] = (), with_record: bool = False) -> DataFrame:
    """One row for each object that is an element of an array in the JSON texts of a column.

    The result has ``id_col``, ``node``, ``parent`` and, with ``with_record``, ``table_path`` (the node without
    positions: the child table the row belongs to) and ``record`` (the JSON text of the object). In the fields of
    ``lone_fields`` an object that stands alone counts as an array of one.
    """
    lone = frozenset(lone_fields)
    source = df.select(F.col(id_col).alias("__id"), F.col(json_col).cast("string").alias("__text"))
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("node", T.StringType()), T.StructField("parent", T.StringType())]
    if with_record:
        fields += [T.StructField("table_path", T.StringType()), T.StructField("record", T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for texts, rows in _chunks(b.column(1)):
                found = nested_rows(texts, rows, lone, with_record)
                cols = [ids.take(pa.array(found["row"], pa.int64())), found["node"].cast(pa.string()), found["parent"].cast(pa.string())]
                if with_record:
                    cols += [pc.replace_substring_regex(cols[1], r"\[\d+\]", "[]"), pa.array(found["record"], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return source.mapInArrow(run, T.StructType(fields))


def child_table(flat: DataFrame, table_path: str, schema: T.StructType) -> DataFrame:
    """The rows of one child table with typed columns, read from ``record``; the link columns keep their names."""
    links = [c for c in flat.columns if c not in ("record", "table_path")]
    parsed = F.from_json("record", schema)
    return flat.where(F.col("table_path") == table_path).select(*links, *(parsed[f.name].alias(f"f_{f.name}" if f.name in links else f.name) for f in schema.fields))
