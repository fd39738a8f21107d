"""Runs against a plain loop and a plain agglomeration, over partition borders."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.runs import _Similar, agglomerate, collapse_runs, label_similarity, tie_keys

SCHEMA = "id long, cam string, ts long, label string, ing long"


def run(df, gap, least=1.0, n=None):
    return collapse_runs(df, F.col("cam"), F.col("id"), [F.col("ts")], F.col("ts"), F.col("label"), F.col("ing"), gap, least, partitions=n).collect()


def brute_equal(rows, gap):
    out = []
    for cam, group in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        runs = []
        for i, _, t, label, _ in group:
            if runs and runs[-1][3] == label and t - runs[-1][5] <= gap:
                runs[-1][1], runs[-1][2], runs[-1][5] = i, runs[-1][2] + 1, t
            else:
                runs.append([i, i, 1, label, t, t])
        out += [(cam, a, b, n, s, e, [x]) for a, b, n, x, s, e in runs]
    return sorted(out)


def brute_near(rows, gap, least):
    """Try every border again and again; merge the most similar, of equals that before the smallest hash."""
    tie = lambda i: int(tie_keys(np.array([i]))[0])
    out = []
    for cam, group in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[2], r[0])), key=lambda r: r[1]):
        runs = [[i, i, 1, {x}, t, t] for i, _, t, x, _ in group]
        while True:
            best = None
            for k in range(1, len(runs)):
                a, b = runs[k - 1], runs[k]
                if b[4] - a[5] <= gap:
                    s = min(label_similarity(x, y) for x in a[3] for y in b[3])
                    if s >= least and (best is None or (s, -tie(b[0])) > best[0]):
                        best = ((s, -tie(b[0])), k)
            if not best:
                break
            k = best[1]
            a, b = runs[k - 1], runs[k]
            runs[k - 1 : k + 1] = [[a[0], b[1], a[2] + b[2], a[3] | b[3], a[4], b[5]]]
        out += [(cam, a, b, n, s, e, sorted(x)) for a, b, n, x, s, e in runs]
    return sorted(out)


def made(seed, n, labels, hot=0.5):
    rng, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 3, 9])
        rows.append((i, "hot" if rng.random() < hot else rng.choice("abc"), t, rng.choice(labels), 0))
    return rows


def test_equal_labels(spark):
    rows = made(1, 1500, ["x", "x", "x", "y"])
    df = spark.createDataFrame(rows + [(*r[:4], 5) for r in rows[::7]], SCHEMA).repartition(5)
    for n in (1, 3, 19):
        assert sorted(map(tuple, run(df, 4, n=n))) == brute_equal(rows, 4), n


def test_one_run_fills_all_partitions(spark):
    df = spark.createDataFrame([(i, "c", i, "x", 0) for i in range(900)], SCHEMA)
    assert [tuple(r) for r in run(df, 5, n=9)] == [("c", 0, 899, 900, 0, 899, ["x"])]


@pytest.mark.parametrize("batch", [10_000, 3])
def test_near_labels(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = made(2, 400, ["smoke", "smoking", "smoked", "knife", "knives"])
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        for least, n in ((0.6, 1), (0.6, 7), (0.8, 5), (0.3, 6)):
            assert sorted(map(tuple, run(df, 4, least, n))) == brute_near(rows, 4, least), (least, n)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_agglomeration_prefers_the_most_similar():
    similar = _Similar({("a", "b"): 0.7, ("b", "c"): 0.9, ("a", "c"): 0.2}.get)
    similar.measure = lambda x, y: {frozenset("ab"): 0.7, frozenset("bc"): 0.9, frozenset("ac"): 0.2}[frozenset((x, y))]
    assert agglomerate([("a",), ("b",), ("c",)], [False, True, True], [0, 1, 2], similar, 0.5) == ([0, 1], [False, False])
    # c may yet be taken by what is behind, and then b by a
    assert agglomerate([("a",), ("b",), ("c",)], [False, True, True], [0, 1, 2], similar, 0.5, right=True) == ([0, 1, 2], [False, True, True])


def test_labels_that_alternate_on_one_camera(spark):
    """One stretch over all partitions: the result is that of the loop, twice the same, and few runs wait at the ends."""
    rng = random.Random(6)
    for pick in (lambda i: ["smoke", "smoked"][i % 2], lambda i: rng.choice(["smoke", "smoked", "smoking", "smokes"])):
        rows = [(i, "hot", i // 2, pick(i), 0) for i in range(700)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        want = brute_near(rows, 5, 0.6)
        for n in (1, 4, 40):
            assert sorted(map(tuple, run(df, 5, 0.6, n))) == want
        labels = [(x,) for *_, x, _ in rows]
        _, waits = agglomerate(labels, [i > 0 for i in range(700)], tie_keys(np.arange(700)).tolist(), _Similar(label_similarity), 0.6, True, True)
        assert sum(waits) < 40


def test_edges(spark):
    rows = [(1, "c", 5, "x", 2), (1, "c", 1, "x", 1), (2, "c", 1, "x", 0), (3, None, 1, "x", 0), (4, "c", None, "x", 0), (5, "c", 2, None, 0), (6, "c", 2, "", 0), (None, "c", 2, "x", 0), (7, "c", 2, "x" * 10_000, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pid", F.lit("clash")).withColumn("entity", F.lit(1)).withColumn("place", F.lit(1))
    got = sorted(map(tuple, run(df, 10)))
    assert got == [("c", 1, 2, 2, 1, 1, ["x"]), ("c", 7, 7, 1, 2, 2, ["x" * 10_000])]
    assert run(df.limit(0), 10) == []
