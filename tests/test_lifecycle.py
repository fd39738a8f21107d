"""Life of events: the fixture scenarios, batch against stream state, and the streaming query."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.operators.lifecycle import EventRule, cooldown_slots, lifecycle
from sightline.streaming.lifecycle import EventState, lifecycle_stream, windowed_counts

S = 1_000_000
C1 = EventRule(3, 2, 10, 30)
LONG = EventRule(3, 2, 10, 30, 5, 1.5)
SMOKE = EventRule(3, 2, 10, 60, 2, 1.0)


def steps(a, b, by):
    return [a + i * by for i in range(round((b - a) / by) + 1)]


SCENARIOS = [
    (C1, [0], []),
    (C1, [0, 0.5, 1.0], [(1.0, "CONFIRMED", 1.0, 3)]),
    (C1, [0, 2.5, 5, 7.5], []),
    (C1, steps(0, 1.9, 0.1), [(0.2, "CONFIRMED", 0.2, 20)]),
    (C1, [0, 0.5, 1, 15, 15.5, 16], [(1, "CONFIRMED", 1, 3), (16, "SUPPRESSED", None, 3)]),
    (C1, [0, 0.5, 1, 40, 40.5, 41], [(1, "CONFIRMED", 1, 3), (41, "CONFIRMED", 41, 3)]),
    (C1, [0, 0.5, 1, *steps(15, 60, 0.5)], [(1, "CONFIRMED", 1, 3), (16, "PROMOTED", 31, 91)]),
    (C1, [0, 0.5, 1, 11, 11.5, 12], [(1, "CONFIRMED", 1, 3), (12, "SUPPRESSED", None, 3)]),
    (LONG, steps(0, 3.9, 0.1), []),
    (LONG, steps(0, 5.9, 0.1), [(5.0, "CONFIRMED", 5.0, 60)]),
    (LONG, steps(0, 3.9, 0.1) + steps(6, 9.9, 0.1) + steps(10, 11.4, 0.1), [(11.0, "CONFIRMED", 11.0, 95)]),
    (SMOKE, [100, 100.2, 100.4, 100.6, 100.8, 101, 101.2, 101.4, 101.6, 101.8, 102], [(102, "CONFIRMED", 102, 11)]),
    (SMOKE, [100, 100.5, 101, 102.5, 103, 103.5, 104, 104.5], [(104.5, "CONFIRMED", 104.5, 8)]),
]


def us(t):
    return None if t is None else round(t * S)


def by_state(rule, rows):
    state, out = EventState(rule), []
    for t, seq, c in sorted(rows):
        if done := state.see(t, seq, c):
            out.append(done)
    if done := state.close():
        out.append(done)
    return out


def test_scenarios_as_state():
    for rule, times, want in SCENARIOS:
        got = by_state(rule, [(us(t), i, 0.5) for i, t in enumerate(times)])
        assert [(e["confirm_us"], e["outcome"], e["notified_us"], e["hits"]) for e in got] == [(us(a), b, us(c), d) for a, b, c, d in want], times


def test_scenarios_as_batch(spark):
    for rule in (C1, LONG, SMOKE):
        mine = [(i, x) for i, x in enumerate(SCENARIOS) if x[0] is rule]
        rows = [(f"c{i}", "t", None, us(t), k, 0.5) for i, (_, times, _) in mine for k, t in enumerate(times)]
        df = spark.createDataFrame(rows, "camera_id string, event_type string, subject string, ts_us long, seq long, confidence double").repartition(3)
        got = sorted((r.camera_id, r.confirm_us, r.outcome, r.notified_us, r.hits) for r in lifecycle(df, rule).collect())
        assert got == sorted((f"c{i}", us(a), b, us(c), d) for i, (_, _, want) in mine for a, b, c, d in want)


def random_rows(seed, n=400):
    rng, t, rows = random.Random(seed), {}, []
    for i in range(n):
        k = rng.choice(["a", "a", "a", "b"])
        t[k] = t.get(k, 0) + rng.choice([0, S // 2, S, S, 2 * S, 3 * S, 12 * S])
        rows.append((k, t[k], i, rng.randint(0, 9) / 10))
    return rows


KEPT = ["started_us", "last_us", "hits", "peak_confidence", "peak_seq", "confirm_us", "outcome", "notified_us", "closed_us"]


@pytest.mark.parametrize("rule", [C1, LONG, SMOKE, EventRule(1, 2, 10, 30), EventRule(2, 1, 3, 5, 1, 2)])
def test_batch_equals_state(spark, rule):
    rows = random_rows(hash(rule.confirm_hits + rule.cooldown_s) % 100)
    df = spark.createDataFrame([(k, "t", None, t, i, c) for k, t, i, c in rows], "camera_id string, event_type string, subject string, ts_us long, seq long, confidence double").repartition(4)
    got = sorted(repr((r.camera_id, *(r[c] for c in KEPT))) for r in lifecycle(df, rule).collect())
    want = sorted(repr((k, *(e[c] for c in KEPT))) for k in "ab" for e in by_state(rule, [(t, i, c) for x, t, i, c in rows if x == k]))
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    rows = random_rows(9, 300)
    schema = "camera_id string, event_type string, subject string, ts_us long, seq long, confidence double"
    rows.sort(key=lambda r: r[1])
    for n, part in enumerate([rows[:120], rows[120:200], rows[200:]]):
        spark.createDataFrame([(k, "t", None, t, i, c) for k, t, i, c in part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    far = max(r[1] for r in rows) + 10_000 * S
    spark.createDataFrame([("zz", "t", None, far, 10_000, 0.1)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = lifecycle_stream(stream, C1, "10000 seconds").writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    df = spark.createDataFrame([(k, "t", None, t, i, c) for k, t, i, c in rows], schema)
    want = {(r.camera_id, *(r[c] for c in KEPT)) for r in lifecycle(df, C1).collect()}
    got = {(r.camera_id, *(r[c] for c in KEPT)) for r in spark.table("closed").collect()}
    last = {k: max(t for x, t, _, _ in rows if x == k) for k in "ab"}
    assert got <= want
    assert {w for w in want if w[2] != last[w[0]]} <= got  # all but what only the final timers close


def test_windowed_counts_stream(spark, tmp_path):
    rows = [("c", "x", 0.5, 0), ("c", "x", 0.7, 30), ("c", "x", 0.1, 70), ("c", "y", 0.2, 5)]
    df = spark.createDataFrame(rows, "camera_id string, label string, confidence double, s long").withColumn("event_time", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "d"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.label, r.n, r.best) for r in spark.table("counts").collect()) == [("x", 1, 0.1), ("x", 2, 0.7), ("y", 1, 0.2)]


def test_cooldown_slots(spark):
    df = spark.createDataFrame([("k", t, i, i != 0) for i, t in enumerate([0, 5, 10, 19, 20, 40])], "k string, t long, s long, ok boolean")
    pick = lambda **x: sorted(r.t for r in cooldown_slots(df, ["k"], "t", "s", 10, **x).collect())
    assert pick() == [0, 10, 20, 40]
    assert pick(inclusive=False) == [0, 19, 40]
    assert pick(success="ok") == [0, 5, 19, 40]


@pytest.mark.parametrize("seed", range(4))
def test_one_key_over_all_partitions(spark, seed):
    rng, t, rows = random.Random(seed), 0, []
    rule = EventRule(rng.choice([1, 2, 3, 6]), 4, 10, rng.choice([5, 30, 90]), *rng.choice([(0,), (5, 1.5)]))
    for i in range(500):
        t += rng.choice([0, S // 2, S, S, 2 * S, 2 * S, *([12 * S] if seed % 2 else [])])
        rows.append(("hot", t, i, rng.randint(0, 9) / 10))
    df = spark.createDataFrame([(k, "t", None, t, i, c) for k, t, i, c in rows], "camera_id string, event_type string, subject string, ts_us long, seq long, confidence double")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for width in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            got = sorted(repr(tuple(r[c] for c in KEPT)) for r in lifecycle(df, rule).collect())
            assert got == sorted(repr(tuple(e[c] for c in KEPT)) for e in by_state(rule, [(t, i, c) for _, t, i, c in rows]))
            slots = cooldown_slots(df.withColumn("ok", F.col("seq") % 3 != 0), ["camera_id"], "ts_us", "seq", 7 * S, inclusive=bool(seed % 2), success="ok")
            last, want = None, []
            for _, t, i, _ in rows:
                if last is None or (t - last >= 7 * S if seed % 2 else t - last > 7 * S):
                    want.append(i)
                    last = t if i % 3 else last
            assert sorted(r.seq for r in slots.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "camera_id string, event_type string, subject string, ts_us long, seq long, confidence double")
    assert lifecycle(df, C1).count() == 0 and cooldown_slots(df, ["camera_id"], "ts_us", "seq", 5).count() == 0


def test_rule_is_checked():
    with pytest.raises(ValueError):
        EventRule(confirm_hits=0)
