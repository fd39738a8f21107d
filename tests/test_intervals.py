"""Periods, gaps, sessions, as-of lookups and ranks that cross partitions, against plain loops."""

import random

from pyspark.sql import functions as F

from sightline.operators.intervals import DAY_MS, merge_intervals, within_day
from sightline.operators.ordered import global_rank, last_before, sessions


def brute_periods(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e >= s:
            by.setdefault(k, []).append((s, e))
    out = []
    for k, v in by.items():
        periods = []
        for s, e in sorted(v):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(k, "period", s, e) for s, e in periods]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=repr)


def test_hot_entity_over_many_partitions(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(3000):  # a third and more of all rows in one entity, long spans over many others
        k = rng.choice(["hot", "hot", "a", "b", None])
        s = rng.randint(0, 20000)
        rows.append((k, s, s + rng.choice([0, 1, 3, 10, 10, -1, rng.randint(0, 3000) if rng.random() < 0.01 else 2])))
    rows += [("x", None, 5), ("x", 5, None), ("y", 7, 7), ("y", 7, 7)]
    df = spark.createDataFrame(rows, "k string, s long, e long").repartition(7)
    for n in (1, 5, 23):
        got = merge_intervals(df, {"k": F.col("k")}, F.col("s"), F.col("e"), partitions=n).collect()
        assert sorted(map(tuple, got), key=repr) == brute_periods(rows), n


def test_small_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(5)
        rows = [(rng.choice("ab"), s := rng.randint(0, 300), s + rng.randint(0, 9)) for _ in range(200)]
        df = spark.createDataFrame(rows, "k string, s long, e long")
        got = merge_intervals(df, {"k": F.col("k")}, F.col("s"), F.col("e"), partitions=4).collect()
        assert sorted(map(tuple, got), key=repr) == brute_periods(rows)
        test_sessions(spark)
        test_last_before(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clashing_names_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "__s long, __e long, kind long, pid long")
    got = merge_intervals(df, {"kind2": F.col("kind")}, F.col("__s"), F.col("__e"))
    assert [tuple(r) for r in got.collect()] == [(3, "period", 1, 2)]
    assert merge_intervals(df.limit(0), {"k": F.col("kind")}, F.col("__s"), F.col("__e")).count() == 0


def test_day_of_gaps(spark):
    rows = [("k", 0, 1000), ("k", 2000, DAY_MS - 5), ("k", DAY_MS + 5, DAY_MS + 6)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    got = within_day(merge_intervals(df, {"k": F.col("k")}, F.col("s"), F.col("e"))).where("kind = 'gap'").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(1000, 2000)]


def test_sessions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["h", "h", "h", "a", None]), rng.randint(0, 900), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t long, i long").repartition(5)
    for touching in (False, True):
        want, last = [], {}
        for k, t, i in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2])):
            p = last.get(k)
            fresh = p is None or (t - p[0] > 4 if touching else t - p[0] >= 4)
            last[k] = (t, t if fresh else p[1])
            want.append((i, last[k][1]))
        got = sessions(df, ["k"], "t", ["i"], 4, touching)
        assert sorted((r.i, r.session) for r in got.collect()) == sorted(want)
    assert sessions(df.limit(0), ["k"], "t", ["i"], 4).count() == 0


def test_last_before(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["h", "h", "a", None]), rng.randint(0, 50), i, float(i) if rng.random() < 0.1 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double").repartition(6)
    want, last = [], {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2])):
        want.append((i, last.get(k)))
        if v is not None:
            last[k] = v
    got = last_before(df, ["k"], "t", ["i"], "v", "p")
    assert sorted((r.i, r.p) for r in got.collect()) == sorted(want)


def test_global_rank(spark):
    rows = [(["h", "h", "h", "a", None][i % 5], (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    want, count = {}, {}
    for k, _, i in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        count[k] = want[i] = count.get(k, 0) + 1
    assert {r.i: r["rank"] for r in global_rank(df, ["k"], ["v", "i"]).collect()} == want
