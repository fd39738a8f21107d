"""Runs of equal or near-equal consecutive events, by adjacent agglomeration.

The events of each entity, in order, start as runs of one. A priority queue over a linked list repeatedly merges the
most similar neighbouring runs until no border meets both limits: the gap from the last event of the left run to the
first of the right one, and the similarity, which is the least over all pairs of their labels. Of equally similar borders
the one comes first whose right event has the smaller hash of its id.

Because the similarity of a border can only fall, a border before both its neighbours in that order is merged whatever
happens elsewhere, and one below the limit is never crossed. So the cluster range-sorts all events by entity and order,
an entity of any size spreading over many partitions, and each partition merges all that doesn't hang on what lies beyond
its ends: only the borders that wait for one at an end, each after the next, are left. As the order of equal borders is
as good as random, such chains are short, even where labels alternate for ever. These few runs, joined to stretches by
the partitions' ends (two rows each), are agglomerated once more.

Defined results: events with a NULL entity, time or label are left out, and those whose label normalises to ''; an id
that occurs several times counts once, by its first ingested row; ties in the order fall to the id; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut, range_width

_NODE = ["entity", "first_id", "last_id", "n", "first_ms", "last_ms", "labels"]


def label_similarity(a: str, b: str) -> float:
    """The share of letter pairs that two labels have in common; 1 only for equal labels."""
    if a == b:
        return 1.0
    p, q = [{x[i : i + 2] for i in range(max(1, len(x) - 1))} for x in (a, b)]
    return min(2 * len(p & q) / (len(p) + len(q)), 0.999999)


class _Similar:
    """The least similarity between two sets of labels, remembered."""

    def __init__(self, measure: Callable[[str, str], float]) -> None:
        self.measure, self.known = measure, {}

    def __call__(self, a: tuple[str, ...], b: tuple[str, ...]) -> float:
        if a == b and len(a) == 1:
            return 1.0
        if (s := self.known.get((a, b))) is None:
            s = self.known[a, b] = min(self.measure(x, y) for x in a for y in b)
        return s


def tie_keys(ids: np.ndarray) -> np.ndarray:
    """A hash of each id, by which equally similar borders are ordered."""
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def agglomerate(labels: Sequence[tuple[str, ...]], open_border: Sequence[bool], ties: Sequence[int], similar: _Similar, least: float, left: bool = False, right: bool = False) -> tuple[list[int], list[bool]]:
    """The first node of each run after all merges, and whether the border before it waits for what lies beyond an end.

    open_border[i]: whether the gap before node i lets a merge pass. ``left``, ``right``: whether something may lie beyond.
    """
    n = len(labels)
    labels = list(labels)
    after, before, alive, stamp, waits = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, [0] * n, [False] * n
    heap = [(-s, ties[i], i, 0) for i in range(1, n) if open_border[i] and (s := similar(labels[i - 1], labels[i])) >= least]
    heapq.heapify(heap)

    def renew(i: int) -> None:
        stamp[i] += 1
        if (s := similar(labels[before[i]], labels[i])) >= least:
            heapq.heappush(heap, (-s, ties[i], i, stamp[i]))

    while heap:
        s, _, i, seen = heapq.heappop(heap)
        if not alive[i] or stamp[i] != seen:
            continue
        a, c = before[i], after[i]
        # equal labels merge at any time: that changes no border
        if s > -1.0 and ((left if a == 0 else waits[a]) or (right if c == n else waits[c])):
            waits[i] = True
            continue
        alive[i] = False
        after[a] = c
        if c < n:
            before[c] = a
        mine, other = labels[a], labels[i]
        both = mine if mine == other else tuple(sorted({*mine, *other}))
        labels[a] = both
        if both != mine and a > 0 and open_border[a]:
            renew(a)
        if both != other and c < n and open_border[c]:
            renew(c)
    heads = [i for i in range(n) if alive[i]]
    return heads, [waits[i] for i in heads]


def _collapse(nodes: pd.DataFrame, heads: list[int]) -> pd.DataFrame:
    """The runs that start at the given nodes."""
    if len(heads) == len(nodes):
        return nodes
    at = np.asarray(heads)
    ends = np.append(at[1:], len(nodes))
    out = nodes.iloc[at].copy()
    out["last_id"] = nodes["last_id"].to_numpy()[ends - 1]
    out["last_ms"] = nodes["last_ms"].to_numpy()[ends - 1]
    out["n"] = np.add.reduceat(nodes["n"].to_numpy(), at)
    several = nodes["labels"].tolist()
    out["labels"] = pd.Series([several[s] if several[s] == several[e - 1] and e - s < 3 else tuple(sorted({x for v in several[s:e] for x in v})) for s, e in zip(at, ends)], index=out.index, dtype=object)
    return out


class _Partition:
    """The agglomeration of one sorted partition, batch after batch."""

    def __init__(self, max_gap_ms: int, least: float, measure: Callable[[str, str], float]) -> None:
        self.gap, self.least, self.similar = max_gap_ms, least, _Similar(measure)
        self.held: list[pd.DataFrame] = []
        self.at_head = True

    def borders(self, nodes: pd.DataFrame) -> np.ndarray:
        """Whether a merge may pass the gap before each node."""
        entity, start, end = nodes["entity"].to_numpy(), nodes["first_ms"].to_numpy(), nodes["last_ms"].to_numpy()
        passes = np.zeros(len(nodes), dtype=bool)
        passes[1:] = (entity[1:] == entity[:-1]) & (start[1:] - end[:-1] <= self.gap)
        return passes

    def joined(self, nodes: pd.DataFrame) -> list[bool]:
        """Whether each node and the one before it can be of one stretch."""
        labels = nodes["labels"].tolist()
        return [bool(p) and self.similar(labels[i - 1], labels[i]) >= self.least for i, p in enumerate(self.borders(nodes).tolist())]

    def feed(self, rows: pd.DataFrame | None) -> Iterator[tuple[pd.DataFrame, int]]:
        """Finished runs and what they are: 0 inner, 1 waiting for what is before, 2 for what is behind, 3 for both.

        Rows are held until a border that is never crossed follows; no held row is looked at again before.
        """
        if rows is not None and len(rows):
            known = rows if not self.held else pd.concat([self.held[-1].iloc[-1:], rows], ignore_index=True)
            shift = len(known) - len(rows)
            cuts = [i - shift for i, j in enumerate(self.joined(known)) if i >= shift and i and not j]
            begin = 0
            if cuts:
                if cuts[0]:
                    self.held.append(rows.iloc[: cuts[0]])
                yield from self.merge(pd.concat(self.held, ignore_index=True), False)
                begin = cuts[-1]
                if begin > cuts[0]:
                    yield from self.merge(rows.iloc[cuts[0] : begin].reset_index(drop=True), False)
            self.held = [rows.iloc[begin:]] if cuts else [*self.held, rows]
        elif rows is None and self.held:
            yield from self.merge(pd.concat(self.held, ignore_index=True), True)

    def merge(self, nodes: pd.DataFrame, last: bool) -> Iterator[tuple[pd.DataFrame, int]]:
        """Whole stretches, of which the first may go on before the partition and the last behind it."""
        heads, waits = agglomerate(nodes["labels"].tolist(), self.borders(nodes).tolist(), tie_keys(nodes["first_id"].to_numpy()).tolist(), self.similar, self.least, self.at_head, last)
        runs = _collapse(nodes, heads)
        ends = [i for i, w in enumerate(waits) if not w]  # the first one and those after a border that is never crossed
        first = (ends[1] if len(ends) > 1 else len(runs)) if self.at_head else 0
        tail = ends[-1] if last else len(runs)
        if first and tail < first:
            yield runs, 3
        else:
            for part, place in ((runs.iloc[:first], 1), (runs.iloc[first:tail], 0), (runs.iloc[tail:], 2)):
                if len(part):
                    yield part, place
        self.at_head = False


def collapse_runs(
    df: DataFrame,
    entity: Column,
    event_id: Column,
    order: Sequence[Column],
    time_ms: Column,
    label: Column,
    ingested: Column,
    max_gap_ms: int,
    min_similarity: float = 1.0,
    measure: Callable[[str, str], float] = label_similarity,
    partitions: int | None = None,
) -> DataFrame:
    """One row per run: ``entity``, ``first_id``, ``last_id``, ``n``, ``first_ms``, ``last_ms`` and its ``labels``."""
    spark = df.sparkSession
    ranks = [f"__o{i}" for i in range(len(order))]
    rows = df.select(entity.alias("entity"), event_id.cast("bigint").alias("id"), time_ms.cast("bigint").alias("ms"), label.cast("string").alias("label"), ingested.alias("__in"), *(c.alias(r) for c, r in zip(order, ranks)))
    rows = rows.where("entity IS NOT NULL AND ms IS NOT NULL AND label <> '' AND id IS NOT NULL")
    kept = ["__in", "entity", *ranks, "ms", "label"]
    once = rows.groupBy("id").agg(F.min(F.struct(*kept)).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in kept[1:]))
    sort = ["entity", *ranks, "id"]
    ordered = once.repartitionByRange(partitions or range_width(spark), *sort).sortWithinPartitions(*sort)
    ordered = ordered.select("entity", "id", "ms", "label", F.spark_partition_id().alias("pid"))

    fields = [T.StructField("entity", df.select(entity.alias("e")).schema["e"].dataType), *(T.StructField(c, T.LongType()) for c in _NODE[1:6]), T.StructField("labels", T.ArrayType(T.StringType()))]
    marked = [*fields, T.StructField("pid", T.LongType()), T.StructField("at", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("edge", T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, pid, first, given = _Partition(max_gap_ms, min_similarity, measure), None, True, 0
        kind: pa.DataType | None = None

        def give(found: pd.DataFrame, place: int, last: bool) -> pa.RecordBatch:
            nonlocal first, given
            edge = np.zeros(len(found), dtype=np.int32)
            if first:
                edge[0] |= 1
                first = False
            if last:
                edge[-1] |= 2
            n = len(found)
            given += n
            return pa.RecordBatch.from_arrays(
                [pa.array(found["entity"], kind), *(pa.array(found[c].to_numpy(), pa.int64()) for c in _NODE[1:6]), pa.array(found["labels"].tolist(), pa.list_(pa.string())), pa.array(np.full(n, pid), pa.int64()), pa.array(np.arange(given - n, given), pa.int64()), pa.array(np.full(n, place), pa.int32()), pa.array(edge)],
                names=[*_NODE, "pid", "at", "place", "edge"],
            )

        made: dict[str, tuple[str, ...]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            if pid is None:
                pid, kind = b.column(4)[0].as_py(), b.column(0).type
            ids, ms = b.column(1).to_numpy(), b.column(2).to_numpy()
            sets = [made.setdefault(v, (v,)) for v in b.column(3).to_pylist()]
            rows = pd.DataFrame({"entity": b.column(0).to_pandas(), "first_id": ids, "last_id": ids, "n": np.ones(len(ids), np.int64), "first_ms": ms, "last_ms": ms})
            rows["labels"] = pd.Series(sets, dtype=object)
            for found, place in work.feed(rows):
                yield give(found, place, False)
        for found, place in work.feed(None):
            if len(found):
                yield give(found, place, place in (2, 3))

    made = cut(ordered.mapInArrow(run, T.StructType(marked)))
    inner = made.where("place = 0").select(*_NODE)
    stretches = _stretches(made.where("edge > 0").collect(), max_gap_ms, min_similarity, measure)  # two rows a partition
    if not stretches:
        return inner
    links = F.broadcast(spark.createDataFrame(stretches, "pid long, head long, tail long"))
    border = made.where("place > 0").join(links, "pid").withColumn("stretch", F.when(F.col("place") == 2, F.col("tail")).otherwise(F.col("head")))
    border = border.select(*_NODE, "stretch", "pid", "at")
    def stitch(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values(["pid", "at"], kind="stable").reset_index(drop=True)
        nodes["labels"] = pd.Series([tuple(x) for x in nodes["labels"]], dtype=object)
        work = _Partition(max_gap_ms, min_similarity, measure)
        ties = tie_keys(nodes["first_id"].to_numpy()).tolist()
        out = _collapse(nodes, agglomerate(nodes["labels"].tolist(), work.borders(nodes).tolist(), ties, work.similar, min_similarity)[0])
        return out.assign(labels=[list(x) for x in out["labels"]])[_NODE]

    return inner.unionByName(border.groupBy("stretch").applyInPandas(stitch, T.StructType(fields)))


def _stretches(ends: list, max_gap_ms: int, least: float, measure: Callable[[str, str], float]) -> list[tuple[int, int, int]]:
    """For each partition the number of the stretch it begins with and of the one it ends with."""
    similar = _Similar(measure)
    firsts = {r["pid"]: r for r in ends if r["edge"] & 1}
    lasts = {r["pid"]: r for r in ends if r["edge"] & 2}
    out, count, previous, open_tail = [], 0, None, 0
    for pid in sorted(lasts):
        a, b = firsts[pid], lasts[pid]
        joined = previous is not None and previous["entity"] == a["entity"] and a["first_ms"] - previous["last_ms"] <= max_gap_ms and similar(tuple(previous["labels"]), tuple(a["labels"])) >= least
        if joined:
            head = open_tail
        else:
            count += 1
            head = count
        if b["place"] == 3:
            tail = head
        else:
            count += 1
            tail = count
        out.append((pid, head, tail))
        previous, open_tail = b, tail
    return out
