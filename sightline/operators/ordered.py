"""Scans along the time order of each entity, spread over the cluster.

A window over an entity puts all its rows into one task. Here the rows are range-sorted by entity and order instead, so
that an entity fills as many partitions as it needs; each partition is scanned once for a summary, the summaries (one
row per partition) are combined on the driver, and a second scan starts from the state carried into each partition.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut, range_width


def changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    out = np.zeros(batch.num_rows, dtype=bool)
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def range_sorted(df: DataFrame, order: list[str], ties: Sequence[str] = ()) -> DataFrame:
    """``df`` range-sorted by ``order`` and cut, with the number of each row's partition as ``__pid``.

    Rows that are equal in ``order`` stand in one partition, sorted by ``ties``.
    """
    ordered = df.repartitionByRange(range_width(df.sparkSession), *order).sortWithinPartitions(*order, *ties)
    return cut(ordered.withColumn("__pid", F.spark_partition_id()))


def pid_of(b: pa.RecordBatch) -> int:
    return b.column(b.schema.get_field_index("__pid"))[0].as_py()


def column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def entity_of(b: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(b.column(b.schema.get_field_index(k))[row].as_py() for k in keys)


def summaries(ordered: DataFrame, summarise: Callable[[Iterator[pa.RecordBatch]], object]) -> list[tuple[int, object]]:
    """What ``summarise`` makes of each partition that isn't empty, in their order: one small object per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        if (first := next(full, None)) is not None:
            made = pickle.dumps(summarise(chain([first], full)))
            yield pa.RecordBatch.from_arrays([pa.array([pid_of(first)], pa.int64()), pa.array([made], pa.binary())], names=["pid", "made"])

    made = ordered.mapInArrow(run, "pid long, made binary").collect()
    return [(r["pid"], pickle.loads(bytes(r["made"]))) for r in sorted(made, key=lambda r: r["pid"])]


def rescan(ordered: DataFrame, carried: dict, scan: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """The partitions once more, each from the state carried into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (b for b in batches if b.num_rows)
        if (first := next(full, None)) is not None:
            yield from scan(carried.get(pid_of(first)), chain([first], full))

    return ordered.mapInArrow(run, schema)


class _Sessions:
    """state: (entity values, time of its last row, start of its open session)."""

    def __init__(self, keys: list[str], time: str, gap: int, touching: bool, state: tuple | None = None) -> None:
        self.keys, self.time, self.gap, self.touching, self.state = keys, time, gap, touching, state
        self.first: tuple | None = None
        self.unbroken = True

    def feed(self, b: pa.RecordBatch) -> np.ndarray:
        """The session start of each row."""
        t = b.column(b.schema.get_field_index(self.time)).to_numpy()
        entity = tuple(b.column(b.schema.get_field_index(k))[0].as_py() for k in self.keys)
        last_entity = tuple(b.column(b.schema.get_field_index(k))[b.num_rows - 1].as_py() for k in self.keys)
        if self.first is None:
            self.first = (entity, int(t[0]))
        goes_on = self.state is not None and self.state[0] == entity
        step = np.empty(len(t), dtype=np.int64)
        step[1:] = t[1:] - t[:-1]
        step[0] = t[0] - self.state[1] if goes_on else 0
        fresh = changes(b, self.keys) | (step > self.gap if self.touching else step >= self.gap)
        fresh[0] = not goes_on or (step[0] > self.gap if self.touching else step[0] >= self.gap)
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(t)), -1))
        start = np.where(at >= 0, t[np.maximum(at, 0)], self.state[2] if self.state else 0)
        if self.state is None:
            self.unbroken = not fresh[1:].any()
        else:
            self.unbroken &= not fresh.any()
        self.state = (last_entity, int(t[-1]), int(start[-1]))
        return start


def sessions(df: DataFrame, keys: list[str], time: str, ties: list[str], gap: int, touching: bool = False, name: str = "session") -> DataFrame:
    """``df`` with the time at which each row's session began; the result is cut off from its lineage.

    A session of an entity ends where the next row is ``gap`` or more away (``touching``: more than that). ``time`` is a
    BIGINT column; rows in which it is NULL are left out. NULL is an ordinary value of a key. An empty table stays empty.
    """
    spark, order = df.sparkSession, [*keys, time, *ties]
    ordered = df.where(F.col(time).isNotNull()).repartitionByRange(range_width(spark), *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("__pid", F.spark_partition_id()))
    kinds = [ordered.schema[k] for k in keys]
    ends = T.StructType([*(T.StructField(f"f_{f.name}", f.dataType) for f in kinds), *(T.StructField(f"l_{f.name}", f.dataType) for f in kinds), *(T.StructField(c, T.LongType()) for c in ("pid", "first", "last", "start", "unbroken"))])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, pid, types = _Sessions(keys, time, gap, touching), None, []
        for b in batches:
            if b.num_rows:
                scan.feed(b)
                pid = b.column(b.schema.get_field_index("__pid"))[0].as_py()
                types = [b.column(b.schema.get_field_index(k)).type for k in keys]
        if pid is not None:
            values = [pa.array([v], t) for ends in (scan.first[0], scan.state[0]) for v, t in zip(ends, types)]
            yield pa.RecordBatch.from_arrays([*values, *(pa.array([int(v)], pa.int64()) for v in (pid, scan.first[1], scan.state[1], scan.state[2], scan.unbroken))], names=ends.names)

    carried, state = {}, None
    for r in sorted(ordered.select(*keys, time, "__pid").mapInArrow(summarise, ends).collect(), key=lambda r: r["pid"]):
        carried[r["pid"]] = state
        first, last = tuple(r[f"f_{k}"] for k in keys), tuple(r[f"l_{k}"] for k in keys)
        near = state is not None and state[0] == first and (r["first"] - state[1] <= gap if touching else r["first"] - state[1] < gap)
        state = (last, r["last"], state[2] if near and r["unbroken"] else r["start"])

    out = T.StructType([*(f for f in ordered.schema.fields if f.name != "__pid"), T.StructField(name, T.LongType())])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for b in batches:
            if not b.num_rows:
                continue
            at = b.schema.get_field_index("__pid")
            if scan is None:
                scan = _Sessions(keys, time, gap, touching, carried[b.column(at)[0].as_py()])
            start = pa.array(scan.feed(b), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), start], names=out.names)

    return ordered.mapInArrow(rescan, out)


class _Last:
    """state: (entity values, last value that wasn't NULL, or None)."""

    def __init__(self, keys: list[str], value: str, state: tuple | None = None) -> None:
        self.keys, self.value, self.state, self.entities = keys, value, state, 0

    def feed(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """For each row the last value of its entity before it, and whether there is one."""
        n = b.num_rows
        column = b.column(b.schema.get_field_index(self.value))
        known = np.asarray(column.is_valid())
        values = column.fill_null(0).to_numpy(zero_copy_only=False)
        entity, last_entity = (tuple(b.column(b.schema.get_field_index(k))[i].as_py() for k in self.keys) for i in (0, n - 1))
        change = changes(b, self.keys)
        goes_on = self.state is not None and self.state[0] == entity
        self.entities += int(change.sum()) + (not goes_on)
        begin = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        at = np.maximum.accumulate(np.where(known, np.arange(n), -1))
        before = np.concatenate([[-1], at[:-1]])
        found = before >= begin
        out = values[np.maximum(before, 0)].copy()
        if goes_on and self.state[1] is not None:
            head = (begin == 0) & ~found
            out[head], found[head] = self.state[1], True
        own = at[n - 1] >= begin[n - 1]
        carried = self.state[1] if goes_on and begin[n - 1] == 0 else None
        self.state = (last_entity, values[at[n - 1]].item() if own else carried)
        return out, found


def last_before(df: DataFrame, keys: list[str], time: str, ties: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the last ``value`` that isn't NULL among the earlier rows of the same entity: a backward as-of lookup.

    Rows whose ``time`` is NULL are left out. NULL is an ordinary value of a key. An empty table stays empty.
    """
    order = [*keys, time, *ties]
    ordered = df.where(F.col(time).isNotNull()).repartitionByRange(range_width(df.sparkSession), *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("__pid", F.spark_partition_id()))
    kinds, kind = [ordered.schema[k] for k in keys], ordered.schema[value].dataType
    ends = T.StructType([*(T.StructField(f"f_{f.name}", f.dataType) for f in kinds), *(T.StructField(f"l_{f.name}", f.dataType) for f in kinds), T.StructField("pid", T.LongType()), T.StructField("entities", T.LongType()), T.StructField("value", kind)])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, pid, first, types = _Last(keys, value), None, None, []
        for b in batches:
            if b.num_rows:
                if pid is None:
                    pid = b.column(b.schema.get_field_index("__pid"))[0].as_py()
                    first = tuple(b.column(b.schema.get_field_index(k))[0].as_py() for k in keys)
                    types = [b.column(b.schema.get_field_index(k)).type for k in (*keys, value)]
                scan.feed(b)
        if pid is not None:
            named = [pa.array([v], t) for e in (first, scan.state[0]) for v, t in zip(e, types)]
            yield pa.RecordBatch.from_arrays([*named, pa.array([pid], pa.int64()), pa.array([scan.entities], pa.int64()), pa.array([scan.state[1]], types[-1])], names=ends.names)

    carried, state = {}, None
    for r in sorted(ordered.select(*keys, value, "__pid").mapInArrow(summarise, ends).collect(), key=lambda r: r["pid"]):
        carried[r["pid"]] = state
        last = tuple(r[f"l_{k}"] for k in keys)
        same = state is not None and state[0] == last and r["entities"] == 1
        state = (last, state[1] if same and r["value"] is None else r["value"])

    out = T.StructType([*(f for f in ordered.schema.fields if f.name != "__pid"), T.StructField(name, kind)])

    def rescan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for b in batches:
            if not b.num_rows:
                continue
            at = b.schema.get_field_index("__pid")
            if scan is None:
                scan = _Last(keys, value, carried[b.column(at)[0].as_py()])
            values, found = scan.feed(b)
            kind = b.column(b.schema.get_field_index(value)).type
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(values, kind, mask=~found)], names=out.names)

    return ordered.mapInArrow(rescan, out)


def global_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's rank (from 1) within its key in the given order, which must be total.

    Rows are range-sorted over the cluster; a row's place in its partition, the sizes of the partitions before (one
    number each) and the first place of each key give the rank, so no key is held by one task.
    """
    spark, sort = df.sparkSession, [*keys, *order]
    ordered = df.repartitionByRange(range_width(spark), *sort).sortWithinPartitions(*sort)
    ordered = cut(ordered.withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, total = [], 0
    for r in sorted(ordered.groupBy("__pid").count().collect()):  # one row per partition
        before.append((r["__pid"], total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(before, "__pid int, __before long"))
    placed = ordered.join(offsets, "__pid").withColumn("__at", F.col("__before") + F.col("__at"))
    first = placed.groupBy(*keys).agg(F.min("__at").alias("__first"))
    first = first.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__first")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return placed.join(first, same).withColumn(name, F.col("__at") - F.col("__first") + 1).select(*df.columns, name)
