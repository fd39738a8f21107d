"""Near hashes against comparing all with all; groups taken in order against a plain loop."""

import random

from pyspark.sql import functions as F

from sightline.operators.dataset import band_plan, grouped_split, groups_under_cap, near_candidates, near_hashes, take_in_order


def hashes(seed, n, bits=64):
    rng, out = random.Random(seed), []
    while len(out) < n:
        h = rng.getrandbits(bits)
        out.append(h)
        for _ in range(rng.randint(0, 3)):
            for b in rng.sample(range(bits), rng.randint(0, 9)):
                h ^= 1 << b
            out.append(h)
    return [h - (1 << 64) if h >> 63 else h for h in out[:n]]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "hash long").repartition(3)


def test_near_hashes(spark):
    a, b = hashes(1, 150), hashes(1, 260)
    for radius in (0, 1, 4, 6, 15):
        want = {(x, y, d) for x in a for y in b if (d := ((x ^ y) & ((1 << 64) - 1)).bit_count()) <= radius}
        got = near_hashes(frame(spark, [*a, a[0], None]), frame(spark, [*b, None]), radius)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert near_hashes(frame(spark, a).limit(0), frame(spark, b), 6).count() == 0
    assert near_hashes(frame(spark, a), frame(spark, b).limit(0), 6).count() == 0


def test_bands_meet_less_than_all_with_all(spark):
    a, b = hashes(2, 1000), hashes(3, 1000)
    for radius, most in ((4, 0.01), (6, 0.02)):
        assert near_candidates(frame(spark, a), frame(spark, b), radius).count() < most * len(a) * len(b)
    small, large = (sum(len(m) + n * len(m) / 2**w for _, w, m in band_plan(4, n)) for n in (10**4, 10**8))
    assert large / small < (10**4) ** 0.5  # of the work for each row, over ten thousand times as many rows


def test_groups_in_order(spark, monkeypatch):
    rng = random.Random(4)
    for turn, sizes in enumerate(([1] * 300, [rng.randint(1, 40) for _ in range(300)], [1, 50] * 100, [900, 5, 5], [])):
        data = [(f"g{i}", n, rng.choice([0, 1]), f"{rng.random():.12f}") for i, n in enumerate(sizes)]
        df = spark.createDataFrame(data, "grp string, size long, stratum int, h string")
        limits = {0: (120, 150), 1: (float("inf"), 95)}
        want = set()
        for stratum, (enough, most) in limits.items():
            total = 0
            for g, n, s, h in sorted(data, key=lambda r: (r[3], r[0])):
                if s == stratum and total < enough and total + n <= most:
                    total += n
                    want.add(g)
        assert {r.grp for r in take_in_order(df, limits).collect()} == want, turn


def test_one_group_and_nulls(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i}", i % 7 == 0) for i in range(300)] + [(999, None, True)], "id long, grp string, flag boolean")
    got = grouped_split(df)
    assert got.groupBy("grp").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0 and got.count() == 300
    assert groups_under_cap(df.limit(0), 10).count() == 0 and grouped_split(df.limit(0)).count() == 0
