"""Sets of related records against union-find; the splits' proportions and soundness."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sightline.llm.splits import SHARES, apportion, deal, linked_sets, path_keys, record_forest, split_key, spread, torn_sets


def union_find(rows):
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    seen = {}
    for i, keys in rows:
        for k in keys or ():
            if k is not None:
                a, b = root(i), root(seen.setdefault(k, i))
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def made(seed, n):
    rng = random.Random(seed)
    rows = [(rng.randint(0, n), [f"k{rng.randint(0, n)}" for _ in range(rng.randint(0, 2))]) for _ in range(n)]
    rows += [(10_000 + i, ["hot", f"h{i}"]) for i in range(n // 3)]  # one key holds a third of all
    rows += [(20_000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(40)]  # a long chain
    return rows + [(-5, None), (-6, [None]), (-6, ["k1"])]


def test_sets(spark):
    rows = made(1, 240)
    df = spark.createDataFrame(rows, "id long, keys array<string>").repartition(5)
    got = {r.id: r.set_id for r in linked_sets(df, F.col("id"), F.col("keys")).collect()}
    assert got == union_find(rows)


def test_forest_spans(spark):
    rows = made(2, 120)
    df = spark.createDataFrame(rows, "id long, keys array<string>").repartition(4)
    edges = [(r.id, r.key) for r in record_forest(df, F.col("id"), F.col("keys")).collect()]
    member = {(i, k) for i, keys in rows for k in keys or () if k is not None}
    assert len(set(edges)) == len(edges) and set(edges) <= member
    sets = union_find(rows)
    nodes = {i for i, _ in member} | {k for _, k in member}
    assert len(edges) == len(nodes) - len({sets[i] for i, _ in member})  # a tree per set, no cycle
    again = union_find([(i, [k]) for i, k in edges])
    assert {i: s for i, s in sets.items() if i in again} == again


def test_torn(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"]), (3, ["b"]), (4, []), (5, ["c"]), (6, ["c"])], "id long, keys array<string>")
    splits = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (3, "train"), (4, None), (5, None), (6, "val")], "id long, split string")
    got = sorted((r.id, r.set_id) for r in torn_sets(linked_sets(df, F.col("id"), F.col("keys")), splits).collect())
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_paths_and_splits(spark):
    rows = {"a/REC-0012_ACT 07/x": ["rec12", "act7"], "rec12act07.mp4": ["rec12"], "contact 5_direct7": [], None: None, "": [], "rec_000": ["rec0"], "rec--5": [], "Rec 3/rec0003": ["rec3"], "act12_act 12": ["act12"]}
    df = spark.createDataFrame([(k, v) for k, v in rows.items()], "p string, want array<string>")
    for r in df.select("p", "want", path_keys(F.col("p")).alias("got")).collect():
        assert r.got == r.want or (r.p == "rec12act07.mp4" and set(r.got) <= {"rec12", "act7"}), r
    names = spark.createDataFrame([(s,) for s in (" Tune", "VALID ", "validation", "val", "Test\t", "", " ", None, "dev")], "s string")
    assert [r[0] for r in names.select(split_key(F.col("s"))).collect()] == ["train", "val", "val", "val", "test", None, None, None, "dev"]


def shares(rows):
    n = len(rows)
    return {k: c / n for k, c in Counter(r.split for r in rows).items()}


def test_deal(spark):
    rng = random.Random(4)
    for large in ([], [1500], [600] * 9, [300] * 4 + [40] * 90):
        sizes = large + [rng.choice([1, 1, 1, 2, 3, 5, 9]) for _ in range(1500)]
        rows = [(i, s) for i, s in enumerate(s for s, n in enumerate(sizes) for _ in range(n))]
        sets = spark.createDataFrame(rows, "id long, set_id long").repartition(6)
        got = deal(sets).collect()
        assert len(got) == len(rows)
        by = defaultdict(set)
        for r in got:
            by[r.set_id].add(r.split)
        assert all(len(v) == 1 for v in by.values())
        share = shares(got)
        if len(large) != 9:
            assert all(abs(share[k] - v) < 0.005 for k, v in SHARES.items()), share
        else:  # nine sets of a fourteenth each
            assert abs(share["train"] - 0.8) < 0.05
        assert sorted((r.id, r.split) for r in deal(sets.repartition(2)).collect()) == sorted((r.id, r.split) for r in got)


def test_apportion_and_spread(spark):
    assert apportion(9, {"train": 80, "validation": 10, "test": 10}) == {"train": 7, "validation": 1, "test": 1}
    assert apportion(1, {"train": 8, "validation": 1, "test": 1}) == {"train": 1, "validation": 0, "test": 0}
    assert apportion(5, {"train": -3, "validation": 0, "test": 0}) == {"train": 5, "validation": 0, "test": 0}
    for n, counts in ((100, {"train": 80, "validation": 10, "test": 10}), (7, {"train": 3, "validation": 2, "test": 2}), (3, {"train": 0, "validation": 0, "test": 3})):
        got = [r[0] for r in spark.range(n).select(spread(F.col("id"), n, counts)).collect()]
        assert Counter(got) == {k: v for k, v in counts.items() if v}
        if n == 100:
            assert all(15 <= Counter(got[i : i + 20])["train"] <= 17 for i in range(0, 100, 20))


def test_empty(spark):
    df = spark.createDataFrame([], "id long, keys array<string>")
    sets = linked_sets(df, F.col("id"), F.col("keys"))
    assert sets.count() == 0 and deal(sets).count() == 0
    lone = spark.createDataFrame([(1, None), (None, ["a"])], "id long, keys array<string>")
    assert [tuple(r) for r in linked_sets(lone, F.col("id"), F.col("keys")).collect()] == [(1, 1)]
