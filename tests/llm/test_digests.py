"""Digests: rank errors within the bound, certificates exact, merging in any grouping."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline.llm.digests import FAN_IN, PERCENTILES, _join, certified, cluster, digests, merge_digests, percentile, promise


def error(values, q, v):
    lt, le, n = (values < v).sum(), (values <= v).sum(), len(values)
    return max(0, lt - q * n, q * n - le) / n


def test_clusters_keep_counts_and_bounds():
    rng = np.random.default_rng(0)
    for data in (rng.normal(size=30_000), rng.pareto(1, 30_000), np.repeat([1.0, 2.0], 9000), np.concatenate([np.full(2400, 33.3), np.full(700, 0.1), rng.normal(33, 9, 8000)]), np.arange(3.0), np.array([7.0])):
        values = np.sort(data)
        m, c = cluster(values, np.ones(len(values), dtype=np.int64))
        assert c.sum() == len(values) and math.isclose((m * c).sum(), values.sum(), rel_tol=1e-9)
        for q in PERCENTILES:
            assert error(values, q, percentile(q, values[0], values[-1], m, c)) <= promise(q, 1, c)


def test_promise_holds_for_deep_and_uneven_merges():
    rng = np.random.default_rng(4)
    for fan_in in (2, 7, 64):
        parts = [np.sort(np.round(rng.normal(rng.choice([0, 5, 40]), rng.choice([0.1, 3]), rng.integers(1, 9000)), rng.choice([1, 9]))) for _ in range(200)]
        level, depth = [cluster(p, np.ones(len(p), dtype=np.int64)) for p in parts], 1
        while len(level) > 1:
            level = [_join(level[i : i + fan_in], 500.0) for i in range(0, len(level), fan_in)]
            depth += 1
        (m, c), values = level[0], np.sort(np.concatenate(parts))
        assert len(m) < 1000 and c.sum() == len(values)
        for q in (0.01, *PERCENTILES):
            e = error(values, q, percentile(q, values[0], values[-1], m, c))
            assert e <= promise(q, depth, c) < 0.01 * depth + 0.02


def rows(seed=1):
    rng, out = random.Random(seed), []
    for i in range(400):
        k = "hot" if i % 2 else rng.choice(["a", "b", None])
        v = [rng.choice([rng.gauss(50, 9), rng.expovariate(0.01), 3.0, -1.0, math.nan, math.inf, None]) for _ in range(rng.randint(0, 150))]
        out.append((k, i % 5, rng.choice([v, v, v, None, []])))
    return out


def clean(data, key):
    by = {}
    for k, d, v in data:
        good = [x for x in v or () if x is not None and math.isfinite(x) and x >= 0]
        if good:
            by.setdefault(key(k, d), []).extend(good)
    return {k: np.array(v) for k, v in by.items()}


def test_certificates(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, d int, v array<double>").withColumn("n", F.lit("clash")).repartition(6)
    want = clean(data, lambda k, d: (k, d))
    got = certified(df, {"k": F.col("k"), "d": F.col("d")}, F.col("v")).collect()
    assert {(r.k, r.d) for r in got} == set(want)
    for r in got:
        values = want[r.k, r.d]
        assert r.n == len(values) == sum(r.counts) and (r.low, r.high) == (values.min(), values.max())
        for q, v, e, b in ((0.5, r.p50, r.e50, r.b50), (0.9, r.p90, r.e90, r.b90), (0.99, r.p99, r.e99, r.b99)):
            assert math.isclose(e, error(values, q, v), abs_tol=1e-12) and e <= b


def test_tree_of_merges(spark, monkeypatch):
    monkeypatch.setattr("sightline.llm.digests.FAN_IN", 2)
    test_certificates(spark)


def test_hot_group_over_many_parts(spark):
    rows = spark.range(0, 300_000, 1, 3 * FAN_IN).select(F.lit("hot").alias("k"), F.array((F.col("id") * 7919 % 300_007).cast("double")).alias("v"))
    seen = []
    for width in ("3", "500"):
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            seen.append([tuple(map(str, r)) for r in certified(rows, {"k": F.col("k")}, F.col("v")).collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1]
    r = certified(rows, {"k": F.col("k")}, F.col("v")).first()
    assert r.n == 300_000 and r.levels == 3 and r.e50 <= r.b50 and r.e90 <= r.b90 and r.e99 <= r.b99 and len(r.means) < 1000


def test_parts_merge(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, d int, v array<double>").repartition(3)
    days = digests(df, {"k": F.col("k"), "d": F.col("d")}, F.col("v"))
    whole = merge_digests(merge_digests(days.withColumn("half", F.col("d") % 2), ["k", "half"]), ["k"])
    want = clean(data, lambda k, d: k)
    got = certified(df, {"k": F.col("k")}, F.col("v"), whole).collect()
    assert {r.k: r.n for r in got} == {k: len(v) for k, v in want.items()}
    assert all(r.e50 <= r.b50 and r.e99 <= r.b99 for r in got)


def test_empty(spark):
    df = spark.createDataFrame([("a", [-1.0, float("nan")]), ("b", None)], "k string, v array<double>")
    assert certified(df, {"k": F.col("k")}, F.col("v")).count() == 0
    assert certified(df.limit(0), {"k": F.col("k")}, F.col("v")).count() == 0
