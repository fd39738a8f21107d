"""Slots that rows of an entity claim one after another, at least a cooldown apart, spread over the cluster.

Along the time order of an entity a row claims the slot if the last claim is a cooldown away. So each claim points to the
next one: the first row far enough from it. The rows are range-sorted by entity and time; in each partition these pointers
are found by binary search, and followed from every row that could be the first to claim there, which lie within one
cooldown of its beginning. A partition's summary tells for each of them where the chain leaves it; the driver goes
through the summaries (one small object a partition) and a second scan marks the claims from the state carried in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sightline.operators.ordered import changes, column, entity_of, rescan, summaries


@dataclass(frozen=True)
class Claim:
    """The columns of the rows, and when a row may claim.

    ``may``: a BOOLEAN column; only rows in which it is true claim. ``unit``: a BIGINT column that parts an entity's rows
    into stretches, of which each claims once; then ``may`` holds from its first true row in the unit on.
    """

    keys: list[str]
    time: str
    may: str
    cooldown: int
    inclusive: bool = True
    unit: str | None = None


@dataclass
class _State:
    """After a row: its entity and unit, whether the unit may claim, the last claim's time, and if it is of this unit."""

    entity: tuple
    unit: int | None
    open: bool
    last: int | None = None
    used: bool = False


@dataclass
class _Part:
    """A partition's rows as arrays."""

    rule: Claim
    first: tuple
    last: tuple
    t: np.ndarray
    fresh: np.ndarray
    unit: np.ndarray
    may: np.ndarray
    batches: list[pa.RecordBatch] = field(default_factory=list)

    @classmethod
    def read(cls, rule: Claim, batches: Iterator[pa.RecordBatch], keep: bool = False) -> _Part:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        first = last = None
        held = []
        for b in batches:
            fresh = changes(b, rule.keys)
            start = entity_of(b, rule.keys, 0)
            fresh[0] = first is None or start != last
            first, last = start if first is None else first, entity_of(b, rule.keys, b.num_rows - 1)
            t = column(b, rule.time)
            for c, v in zip(columns, (t, fresh, column(b, rule.unit) if rule.unit else t, column(b, rule.may).astype(bool))):
                c.append(v)
            if keep:
                held.append(b)
        return cls(rule, first, last, *(np.concatenate(c) for c in columns), held)

    def units(self) -> np.ndarray:
        """The number of each row's unit."""
        n = np.arange(len(self.t))
        if not self.rule.unit:
            return n
        return np.cumsum(self.fresh | np.concatenate([[True], self.unit[1:] != self.unit[:-1]])) - 1

    def attempts(self, units: np.ndarray, opened: bool) -> np.ndarray:
        """Which rows may claim; ``opened``: the first unit may from the start."""
        if not self.rule.unit:
            return self.may
        total = np.cumsum(self.may)
        begin = np.searchsorted(units, units)
        return (total - (total - self.may)[begin] > 0) | (opened & (units == 0))

    def pointers(self, units: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For the attempts ``rows`` of one entity the next claim after a claim there, as a number among them."""
        t = self.t[rows]
        far = np.searchsorted(t, t + self.rule.cooldown, "left" if self.rule.inclusive else "right")
        return np.maximum(far, np.searchsorted(units[rows], units[rows], "right"))

    def entry(self, units: np.ndarray, rows: np.ndarray, state: _State | None) -> int:
        """The first of the attempts ``rows`` that claims."""
        if state is None or state.last is None:
            return 0
        k = int(np.searchsorted(self.t[rows], state.last + self.rule.cooldown, "left" if self.rule.inclusive else "right"))
        return max(k, int(np.searchsorted(units[rows], 1))) if state.used and self.goes_on(state) else k

    def goes_on(self, state: _State | None) -> bool:
        """Whether the partition begins in the unit in which ``state`` ended."""
        return self.rule.unit is not None and state is not None and state.entity == self.first and state.unit == int(self.unit[0])

    def summary(self) -> dict:
        units, n = self.units(), len(self.t)
        begin = np.flatnonzero(self.fresh)[-1]
        out = {"first": self.first, "last": self.last, "one": begin == 0, "unit": int(self.unit[0]), "end": int(self.unit[-1]) if self.rule.unit else None, "single": int(units[-1]) == 0, "ways": {}}
        for opened in (False, True) if self.rule.unit and begin == 0 else (False,):
            attempt = self.attempts(units, opened)
            out["open", opened] = bool(attempt[-1])
            rows = begin + np.flatnonzero(attempt[begin:])
            after, t = self.pointers(units, rows), self.t[rows]
            leaves: dict[int, int] = {}

            def leave(k: int, after: np.ndarray = after, leaves: dict[int, int] = leaves) -> int:
                path = []
                while k not in leaves:
                    path.append(k)
                    if after[k] >= len(after):
                        leaves[k] = k
                        break
                    k = int(after[k])
                for p in path:
                    leaves[p] = leaves[k]
                return leaves[k]

            if begin:
                starts = [0] if len(rows) else []
            else:
                near = int(np.searchsorted(t, self.t[0] + self.rule.cooldown, "right"))
                own = int(np.searchsorted(units[rows], 1))
                starts = sorted({*range(near), *(k for k in (near, max(near, own)) if k < len(rows))})
            ways: list[tuple[int, bool, int, bool]] = []
            for k in reversed(starts):
                e = leave(k)
                way = (int(t[k]), bool(units[rows[k]] >= 1), int(t[e]), bool(units[rows[e]] == units[n - 1]))
                if ways and ways[-1][1:] == way[1:]:
                    continue  # who comes to this one leaves as from the next
                ways.append(way)
            out["ways"][opened] = ways[::-1]
        return out

    def claims(self, state: _State | None) -> np.ndarray:
        """Which rows claim, given the state before the first one."""
        units = self.units()
        attempt = self.attempts(units, self.goes_on(state) and state.open)
        taken = np.zeros(len(self.t), dtype=bool)
        starts = np.append(np.flatnonzero(self.fresh), len(self.t))
        for a, b in zip(starts[:-1], starts[1:]):
            rows = a + np.flatnonzero(attempt[a:b])
            after = self.pointers(units, rows)
            k = self.entry(units, rows, state) if a == 0 and state is not None and state.entity == self.first else 0
            while k < len(rows):
                taken[rows[k]] = True
                k = int(after[k])
        return taken


def _after(rule: Claim, state: _State | None, s: dict) -> _State:
    """The state behind a partition with summary ``s``."""
    same = state is not None and state.entity == s["first"] and s["one"]
    unit = same and rule.unit is not None and state.unit == s["unit"]
    opened = bool(unit and state.open)
    ways = s["ways"][opened]
    last = state.last if same else None
    used = bool(same and state.used and unit and s["single"])
    edge = None if last is None else last + rule.cooldown
    for t, later, leave, there in ways:
        if (edge is None or (t >= edge if rule.inclusive else t > edge)) and (later or not (unit and state.used)):
            last, used = leave, there
            break
    return _State(s["last"], s["end"], s["open", opened], last, used)


def claims(ordered: DataFrame, rule: Claim, name: str = "claimed") -> DataFrame:
    """The rows of ``ordered`` (see ordered.range_sorted) with the BOOLEAN ``name`` and, as ``since``, the last claim before."""
    carried, state = {}, None
    for pid, s in summaries(ordered, lambda batches: _Part.read(rule, batches).summary()):
        carried[pid] = state
        state = _after(rule, state, s)
    schema = T.StructType([*ordered.schema.fields, T.StructField(name, T.BooleanType()), T.StructField("since", T.LongType())])

    def scan(state: _State | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part.read(rule, batches, keep=True)
        taken = part.claims(state)
        n = len(taken)
        at = np.maximum.accumulate(np.where(taken, np.arange(n), -1))
        before = np.concatenate([[-1], at[:-1]])
        known = before >= np.maximum.accumulate(np.where(part.fresh, np.arange(n), 0))
        since = part.t[np.maximum(before, 0)].copy()
        if state is not None and state.last is not None and state.entity == part.first:
            head = (np.cumsum(part.fresh) == 1) & ~known
            since[head], known = state.last, known | head
        a = 0
        for b in part.batches:
            e = a + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(taken[a:e]), pa.array(since[a:e], pa.int64(), mask=~known[a:e])], names=schema.names)
            a = e

    return rescan(ordered, carried, scan, schema)
