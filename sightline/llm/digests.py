"""Percentiles of very large numeric columns per group, by merging centroid digests, with certified rank errors.

Each partition sorts a group's values and clusters them under a size function of the quantile (small clusters at the
tails, large ones in the middle); a digest is the clusters' means and counts with the least and greatest value. Digests
merge by clustering their centroids again, in a tree: :data:`FAN_IN` partitions at a time, until one digest per group is
left, so that no task sees more digests of a hot group than that, however many partitions the input has. Percentiles are
interpolated between centroids. A second pass over the values counts, for each percentile, those below and those not
above it; the distance of the wanted rank from that interval is the certified rank error.

The promised error (:func:`promise`) follows from three facts. Sorted values: of each digest one cluster straddles a
value x, and as the allowed size is concave in the quantile, the straddling clusters of any number of digests together
hold no more than one cell at x. Clustering again adds one cell, since of the new clusters, too, only one straddles x;
clusters that would outgrow a cell aren't made. Reading between two centroids adds half of each. So the promise is a
cell for each level of clustering (kept in the digest) and the halves read from the digest itself.

Only finite values of at least ``least`` count. A group without such values has no row; NULL is an ordinary value of a
key; repeated rows count as often as they occur (take repeats out before); empty tables give an empty result; further
columns are ignored, whatever their names. Digests of days or other parts may be kept and merged at any time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import cut, small

DELTA = 500.0
#: Digests of a group that a task merges at a time.
FAN_IN = 64
BUFFER_VALUES = 1_000_000
PERCENTILES = (0.5, 0.9, 0.99)

_DIGEST = [T.StructField("n", T.LongType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("levels", T.IntegerType()), T.StructField("means", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))]
_FIELDS = [f.name for f in _DIGEST]


def cluster(mean: np.ndarray, count: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Cluster sorted centroids under the size function: those that lie in one cell of arcsin(2q - 1) become one.

    A centroid of several values that crosses the border of two cells stays alone.
    """
    total = np.cumsum(count)
    cell = lambda rank: np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * rank / total[-1] - 1, -1, 1)))
    left, right = cell(total - count + 0.25), cell(total - 0.25)
    crosses = (left != right) & (count > 1)
    at = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | crosses[1:] | crosses[:-1]]))
    size, last = np.add.reduceat(count, at), np.append(at[1:], len(mean)) - 1
    # rounding must not move a mean out of its members, least of all out of equal ones
    return np.clip(np.add.reduceat(mean * count, at) / size, mean[at], mean[last]), size


def promise(q: float, levels: int, count: np.ndarray, delta: float = DELTA) -> float:
    """The bound of the rank error at quantile q of a digest made in so many levels of clustering."""
    n, h = int(count.sum()), 2 * np.pi / delta
    middle = np.cumsum(count) - count / 2
    i = int(np.searchsorted(middle, q * n))
    halves = (count[min(i, len(count) - 1)] + count[max(i - 1, 0)]) / (2 * n)
    error = 0.0
    for _ in range(30):  # the cell at a rank that is off by the error itself
        near = min(q + error, 0.5) if q < 0.5 else max(q - error, 0.5)
        error = levels * (h * np.sqrt(near * (1 - near)) + h * h / 2 + 1 / n) + halves
    return float(error)


def percentile(q: float, low: float, high: float, mean: np.ndarray, count: np.ndarray) -> float:
    """The value at quantile q, between the centroids' middle ranks."""
    total = np.cumsum(count)
    rank = np.concatenate([[0], total - count / 2, [total[-1]]])
    return float(np.interp(q * total[-1], rank, np.concatenate([[low], mean, [high]])))


def _join(parts: list[tuple[np.ndarray, np.ndarray]], delta: float) -> tuple[np.ndarray, np.ndarray]:
    mean, count = np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(mean, kind="stable")
    return cluster(mean[order], count[order], delta)


class _Group:
    """A group's values within a partition: raw ones, and those already clustered."""

    def __init__(self) -> None:
        self.raw: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.low, self.high, self.levels = np.inf, -np.inf, 1

    def pack(self, delta: float, last: bool = False) -> None:
        if self.raw:
            values = np.sort(np.concatenate(self.raw))
            self.low, self.high, self.raw = min(self.low, values[0]), max(self.high, values[-1]), []
            self.parts.append(cluster(values, np.ones(len(values), dtype=np.int64), delta))
        if len(self.parts) >= (2 if last else FAN_IN):
            self.parts, self.levels = [_join(self.parts, delta)], self.levels + 1


def digests(df: DataFrame, keys: dict[str, Column], values: Column, least: float = 0.0, delta: float = DELTA) -> DataFrame:
    """The digest of each group of the values in an array column: the keys, ``n``, ``low``, ``high``, ``levels``, ``means``, ``counts``."""
    names = list(keys)
    rows = df.select(*(c.alias(k) for k, c in keys.items()), values.cast("array<double>").alias("__values"))
    rows = rows.where("__values IS NOT NULL")
    schema = T.StructType([*rows.schema.fields[:-1], *_DIGEST, T.StructField("__part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, _Group] = {}
        types: list[pa.DataType] = []
        held = 0
        for b in batches:
            types = [b.column(i).type for i in range(len(names))]
            lists = b.column(len(names))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            length = np.diff(lists.offsets.to_numpy())
            number: dict[tuple, int] = {}
            of = np.fromiter((number.setdefault(k, len(number)) for k in zip(*(b.column(i).to_pylist() for i in range(len(names))))), dtype=np.int64, count=b.num_rows)
            owner = np.repeat(of, length)
            with np.errstate(invalid="ignore"):
                keep = np.isfinite(flat) & (flat >= least)
            flat, owner = flat[keep], owner[keep]
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
            cuts = np.searchsorted(owner, np.arange(len(number) + 1))
            for k, i in number.items():
                if cuts[i] < cuts[i + 1]:
                    groups.setdefault(k, _Group()).raw.append(flat[cuts[i] : cuts[i + 1]])
            held += len(flat)
            if held > BUFFER_VALUES:
                for g in groups.values():
                    g.pack(delta)
                held = 0
        if not groups:
            return
        for g in groups.values():
            g.pack(delta, last=True)
        made = list(groups.values())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([k[i] for k in groups], t) for i, t in enumerate(types)),
                pa.array([int(g.parts[0][1].sum()) for g in made], pa.int64()),
                pa.array([g.low for g in made], pa.float64()),
                pa.array([g.high for g in made], pa.float64()),
                pa.array([g.levels for g in made], pa.int32()),
                pa.array([g.parts[0][0] for g in made], pa.list_(pa.float64())),
                pa.array([g.parts[0][1] for g in made], pa.list_(pa.int64())),
                pa.array([part] * len(made), pa.int32()),
            ],
            names=[*names, *_FIELDS, "__part"],
        )

    made = cut(rows.mapInArrow(run, schema))
    parts = made.rdd.getNumPartitions()
    while parts > FAN_IN:
        made = merge_digests(made.withColumn("__part", F.floor(F.col("__part") / FAN_IN).cast("int")), [*names, "__part"], delta)
        parts = -(-parts // FAN_IN)
    return merge_digests(made, names, delta)


def merge_digests(df: DataFrame, keys: Sequence[str], delta: float = DELTA) -> DataFrame:
    """One digest per group of ``keys`` out of those of its parts; a group of one part keeps it as it is."""
    keys = list(keys)
    schema = T.StructType([*(df.schema[k] for k in keys), *_DIGEST])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1:
            return pdf[[f.name for f in schema.fields]]
        mean, count = _join([(np.asarray(m), np.asarray(c)) for m, c in zip(pdf["means"], pdf["counts"])], delta)
        out = pdf.iloc[:1][keys].copy()
        out["n"], out["low"], out["high"] = int(count.sum()), pdf["low"].min(), pdf["high"].max()
        out["levels"], out["means"], out["counts"] = int(pdf["levels"].max()) + 1, [mean], [count]
        return out[[f.name for f in schema.fields]]

    return df.select(*keys, *_FIELDS).groupBy(*keys).applyInPandas(run, schema)


def _label(q: float) -> str:
    return f"{100 * q:g}".replace(".", "_")


def estimates(digest: DataFrame, keys: Sequence[str], percentiles: Sequence[float] = PERCENTILES, delta: float = DELTA) -> DataFrame:
    """The digests with for each percentile a column pQ and the promised bound bQ of its rank error."""
    names = [f"{c}{_label(q)}" for c in "pb" for q in percentiles]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def read(low: pd.Series, high: pd.Series, levels: pd.Series, means: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, k, m, c in zip(low, high, levels, means, counts):
            mean, count = np.asarray(m), np.asarray(c)
            rows.append([*(percentile(q, a, b, mean, count) for q in percentiles), *(promise(q, k, count, delta) for q in percentiles)])
        return pd.DataFrame(rows, columns=names)

    return digest.withColumn("__p", read("low", "high", "levels", "means", "counts")).select(*keys, "n", *(F.col(f"__p.{n}").alias(n) for n in names), *_FIELDS[1:])


def _counts(least: float, width: int, percentiles: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows of ``width`` keys, the percentiles and an array of values: the keys, the values below each and up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            length, offsets = np.diff(offsets), offsets - offsets[0]
            with np.errstate(invalid="ignore"):
                good = np.isfinite(flat) & (flat >= least)
                counts = []
                for below in (np.less, np.less_equal):
                    for j in range(percentiles):
                        limit = np.repeat(b.column(width + j).to_numpy(zero_copy_only=False), length)
                        total = np.concatenate([[0], np.cumsum(good & below(flat, limit))])
                        counts.append(total[offsets[1:]] - total[offsets[:-1]])
            names = [*b.schema.names[:width], *(f"__{c}{j}" for c in ("lt", "le") for j in range(percentiles))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(width)), *(pa.array(c, pa.int64()) for c in counts)], names=names)

    return run


def certified(
    df: DataFrame, keys: dict[str, Column], values: Column, digest: DataFrame | None = None, least: float = 0.0, percentiles: Sequence[float] = PERCENTILES, delta: float = DELTA
) -> DataFrame:
    """The percentiles pQ of each group, the certified rank error eQ of each and its promised bound bQ, and the digest.

    ``digest``: digests of the same groups, merged from parts that were kept; else they are made from ``df``.
    """
    names, each = list(keys), range(len(percentiles))
    found = cut(estimates(digests(df, keys, values, least, delta) if digest is None else digest, names, percentiles, delta))
    probe = found.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(names)), *(F.col(f"p{_label(q)}").alias(f"__v{j}") for j, q in enumerate(percentiles)))
    rows = df.select(*(c.alias(f"__r{i}") for i, c in enumerate(keys.values())), values.cast("array<double>").alias("__values")).where("__values IS NOT NULL")
    same = [F.col(f"__r{i}").eqNullSafe(F.col(f"__k{i}")) for i in range(len(names))]
    joined = rows.join(small(probe), same).select(*probe.columns, "__values")
    sums = [f"__{c}{j}" for c in ("lt", "le") for j in each]
    counted = joined.mapInArrow(_counts(least, len(names), len(percentiles)), T.StructType([*probe.schema.fields[: len(names)], *(T.StructField(c, T.LongType()) for c in sums)]))
    ranks = counted.groupBy(*(f"__k{i}" for i in range(len(names)))).agg(*(F.sum(c).alias(c) for c in sums))
    back = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)]
    error = [(F.greatest(F.lit(0.0), F.col(f"__lt{j}") - q * F.col("n"), q * F.col("n") - F.col(f"__le{j}")) / F.col("n")).alias(f"e{_label(q)}") for j, q in enumerate(percentiles)]
    return found.join(ranks, back).select(*names, "n", *(f"p{_label(q)}" for q in percentiles), *error, *(f"b{_label(q)}" for q in percentiles), *_FIELDS[1:])
