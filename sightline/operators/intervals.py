"""Continuous periods and gaps of overlapping intervals per entity.

The rows are range-sorted over the whole cluster by entity and start, so that an entity of any size spreads over as
many partitions as it fills. A first pass reduces each partition to one summary (its last entity, the furthest end of
that entity and the start of its last island). The summaries, one per partition, are prefix-combined on the driver;
a second pass rescans each partition from the state carried into it and labels the islands.

Two intervals that overlap or touch belong to one period. Rows with a NULL start or end, or an end before the start,
are left out; an interval of length zero counts. NULL is an ordinary value of an entity column. Repeated rows change
nothing. An empty input gives an empty result. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut, range_width

DAY_MS = 86_400_000


def _changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """True where a row's entity differs from that of the row before it; the first row is False."""
    n = len(columns[0])
    out = np.zeros(n, dtype=bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


class _Scan:
    """The island scan of sorted rows, batch after batch. state: (entity values, start of the open island, its end)."""

    def __init__(self, state: tuple | None = None) -> None:
        self.state = state
        self.breaks = 0
        self.entities = 0

    def feed(self, keys: list[pa.Array], s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Take a batch; give the islands that ended: row holding the entity (-1: carried), start, end, next start.

        The next start is NO_NEXT where the entity ended with the island.
        """
        n = len(s)
        first = tuple(k[0].as_py() for k in keys)
        goes_on = self.state is not None and self.state[0] == first
        change = _changes(keys)
        self.entities += int(change.sum()) + (not goes_on)
        segment = np.cumsum(change)
        values, rank = np.unique(e, return_inverse=True)
        running = values[np.maximum.accumulate(segment * (n + 1) + rank) - segment * (n + 1)]
        if goes_on:
            head = segment == 0
            running[head] = np.maximum(running[head], self.state[2])
        before = np.empty(n, dtype=np.int64)
        before[1:] = running[:-1]
        before[0] = self.state[2] if goes_on else 0
        starts = change | (s > before)
        starts[0] = not goes_on or s[0] > self.state[2]
        at = np.flatnonzero(starts)
        self.breaks += len(at)
        open_before = self.state is not None
        if not len(at):
            self.state = (first, self.state[1], int(running[-1]))
            return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
        # islands that end in this batch: the carried one (ended by the first break) and all but the last that start here
        begin, rows = s[at[:-1]], at[:-1]
        stop, nxt = running[at[1:] - 1], np.where(change[at[1:]], NO_NEXT, s[at[1:]])
        if open_before:
            k = at[0]
            same = goes_on and not change[k] if k == 0 else not change[k]
            end = self.state[2] if k == 0 else int(running[k - 1])
            begin = np.concatenate([[self.state[1]], begin])
            rows = np.concatenate([[-1], rows])
            stop = np.concatenate([[end], stop])
            nxt = np.concatenate([[s[k] if same else NO_NEXT], nxt])
        self.state = (tuple(c[n - 1].as_py() for c in keys), int(s[at[-1]]), int(running[-1]))
        return rows.astype(np.int64), begin.astype(np.int64), stop.astype(np.int64), nxt.astype(np.int64)


NO_NEXT = np.iinfo(np.int64).min


def _combine(summaries: list[dict], names: list[str]) -> dict[int, tuple | None]:
    """The state carried into each partition, by prefix-combining the partitions' summaries in order."""
    carried: dict[int, tuple | None] = {}
    state: tuple | None = None
    for r in sorted(summaries, key=lambda r: r["pid"]):
        carried[r["pid"]] = state
        last = tuple(r[k] for k in names)
        if r["entities"] == 1 and state is not None and state[0] == last:
            start = r["island"] if r["island"] > state[2] else state[1]
            state = (last, start, max(state[2], r["end"]))
        else:
            state = (last, r["island"], r["end"])
    return carried


def merge_intervals(
    df: DataFrame, keys: dict[str, Column], start_ms: Column, end_ms: Column, partitions: int | None = None
) -> DataFrame:
    """Periods and gaps of the intervals of each entity.

    ``keys`` names the entity columns of the result. The result has those columns and ``kind`` ('period' or 'gap'),
    ``start_ms``, ``end_ms``; gaps of all lengths are listed, see :func:`within_day`.
    """
    spark, names = df.sparkSession, list(keys)
    inner = [f"__key{i}" for i in range(len(names))]
    rows = df.select(*(c.alias(k) for k, c in zip(inner, keys.values())), start_ms.cast("bigint").alias("__s"), end_ms.cast("bigint").alias("__e"))
    rows = rows.where("__s IS NOT NULL AND __e IS NOT NULL AND __e >= __s")
    ordered = rows.repartitionByRange(partitions or range_width(spark), *inner, "__s").sortWithinPartitions(*inner, "__s")
    ordered = cut(ordered.withColumn("__pid", F.spark_partition_id()))
    key_fields = [f for f in ordered.schema.fields if f.name in inner]

    def unpack(b: pa.RecordBatch) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
        return [b.column(b.schema.get_field_index(k)) for k in inner], b.column(b.schema.get_field_index("__s")).to_numpy(), b.column(b.schema.get_field_index("__e")).to_numpy()

    summary_schema = T.StructType([*key_fields, *(T.StructField(c, T.LongType()) for c in ("pid", "entities", "island", "end"))])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, pid, types = _Scan(), None, None
        for b in batches:
            if b.num_rows:
                k, s, e = unpack(b)
                scan.feed(k, s, e)
                pid, types = b.column(b.schema.get_field_index("__pid"))[0].as_py(), [c.type for c in k]
        if pid is not None:
            key, island, end = scan.state
            yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types)), *(pa.array([v], pa.int64()) for v in (pid, scan.entities, island, end))], names=[*inner, "pid", "entities", "island", "end"])

    summaries = [r.asDict() for r in ordered.mapInArrow(summarise, summary_schema).collect()]  # one row per partition
    carried = _combine(summaries, inner)
    final = max(carried, default=None)

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, pid, types = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            k, s, e = unpack(b)
            if scan is None:
                pid, types = b.column(b.schema.get_field_index("__pid"))[0].as_py(), [c.type for c in k]
                scan = _Scan(carried[pid])
            entity = scan.state[0] if scan.state else None
            at, begin, stop, nxt = scan.feed(k, s, e)
            if len(at):
                head = int(at[0] == -1)
                cols = []
                for i, c in enumerate(k):
                    own = c.take(pa.array(at[head:]))
                    cols.append(pa.concat_arrays([pa.array([entity[i]], c.type), own]) if head else own)
                yield _out(cols, begin, stop, nxt, names)
        if pid is not None and pid == final:
            key, island, end = scan.state
            yield _out([pa.array([v], t) for v, t in zip(key, types)], np.array([island]), np.array([end]), np.array([NO_NEXT]), names)

    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, key_fields)), T.StructField("kind", T.StringType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())])
    return ordered.mapInArrow(rescan, schema)


def _out(cols: list[pa.Array], begin: np.ndarray, stop: np.ndarray, nxt: np.ndarray, names: list[str]) -> pa.RecordBatch:
    gap = np.flatnonzero(nxt != NO_NEXT)
    take = pa.array(np.concatenate([np.arange(len(begin)), gap]))
    kind = pa.array(["period"] * len(begin) + ["gap"] * len(gap))
    return pa.RecordBatch.from_arrays(
        [*(c.take(take) for c in cols), kind, pa.array(np.concatenate([begin, stop[gap]]), pa.int64()), pa.array(np.concatenate([stop, nxt[gap]]), pa.int64())],
        names=[*names, "kind", "start_ms", "end_ms"],
    )


def within_day(periods: DataFrame) -> DataFrame:
    """Keep every period, and the gaps whose two ends lie on one UTC day."""
    day = lambda c: F.floor(F.col(c) / F.lit(DAY_MS))
    return periods.where((F.col("kind") == "period") | (day("start_ms") == day("end_ms")))
