"""Rules on detections, zones, poses, blows, suppression and near-duplicates on small hand-made fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from sightline.config import ZONE_SCHEMA, zone_row
from sightline.functions import geometry as G
from sightline.functions import pose as P
from sightline.operators.dataset import dhash, near_any, nearest, refuse_paths, relocate, source_group, split_key
from sightline.operators.evaluate import clip_scores, gate_status, threshold_sweep, choose_threshold
from sightline.operators.nms import suppress
from sightline.operators.policies import LabelRule, climbing, drop_overlapped, label_match, out_of_area, zone_hits
from sightline.operators.report import Route, explain, funnel, targets
from sightline.operators.tracking import Crowd, FightRule, fights, step, tracks

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
DET = f"det_id long, camera_id string, frame_index long, ts double, detector string, module_order int, det_idx int, label string, confidence double, bbox {BOX}, keypoints array<struct<x:double,y:double,confidence:double>>, frame_width int, frame_height int"


def det(i, label, conf, box=(0.0, 0.0, 10.0, 10.0), frame=0, order=0, ts=0.0, kps=None, size=(1000, 1000), camera="c"):
    return (i, camera, frame, float(ts), "d", order, i, label, conf, tuple(map(float, box)) if box else None, kps, *size)


def test_label_match(spark):
    df = spark.createDataFrame([det(1, "person", 0.9), det(2, "scissors", 0.35), det(3, "Knife", 0.6), det(4, "knife", 0.6), det(5, None, 0.6), det(6, "knife", None)], DET)
    got = label_match(df, [LabelRule("hazard", ("knife", "SCISSORS"), 0.4)]).collect()
    assert [(r.det_id, r.match_count, r.confidence) for r in got] == [(3, 2, 0.6)]
    assert label_match(df, [LabelRule("hazard", ("gun",))]).count() == 0
    with pytest.raises(ValueError):
        LabelRule("x", ())


def test_overlap_exclusion(spark):
    def kept(box, label="cigarette", order=1):
        df = spark.createDataFrame([det(1, "scissors", 0.9, (90, 90, 150, 170)), det(2, label, 0.9, box, order=order)], DET)
        return 2 in {r.det_id for r in drop_overlapped(df, ["cigarette"], ["scissors"]).collect()}

    assert not kept((100, 100, 140, 160))
    assert kept((400, 100, 440, 160)) and kept((150, 100, 190, 160))
    assert kept((100, 100, 140, 160), "smoking") and kept((100, 100, 140, 160), order=0)


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 15.0, 15.0)), ((0.0, 0.0, 10.0, 10.0), (13.0, 14.0, 20.0, 20.0)), ((5.0, 5.0, 5.0, 5.0), (5.0, 5.0, 5.0, 5.0)), (None, (0.0, 0.0, 1.0, 1.0))], f"a {BOX}, b {BOX}")
    a, b = F.col("a"), F.col("b")
    got = df.select(G.iou(a, b), G.gap(a, b), G.overlaps(a, b), G.area(a)).collect()
    assert [tuple(r) for r in got] == [(25 / 175, 0.0, True, 100.0), (0.0, 5.0, False, 100.0), (0.0, 0.0, False, 0.0), (0.0, None, None, None)] or tuple(got[1])[1] == 5.0
    cal = spark.createDataFrame([((0.9, 0.6, 0.5, 0.3),)], "c struct<near_foot_y:double,near_height:double,far_foot_y:double,far_height:double>")
    heights = cal.select(*(G.expected_height(F.lit(y), F.col("c")) for y in (0.9, 0.7, 0.3, 1.2, 0.1))).first()
    assert [round(x, 6) for x in heights] == [0.6, 0.45, 0.15, 0.75, 0.15]


def test_polygon_and_hours(spark):
    shape = [(0.0, 0.0), (0.6, 0.0), (0.6, 0.3), (0.3, 0.3), (0.3, 0.6), (0.0, 0.6)]
    df = spark.createDataFrame([(0.1, 0.5, shape), (0.5, 0.1, shape), (0.5, 0.5, shape)], "x double, y double, p array<struct<x:double,y:double>>")
    assert [r[0] for r in df.select(G.in_polygon(F.col("x"), F.col("y"), F.col("p"))).collect()] == [True, True, False]
    hours = spark.createDataFrame([(h * 3600.0, r) for h, r in [(9, [(540, 900)]), (15, [(540, 900)]), (23, [(1320, 360)]), (5, [(1320, 360)]), (12, [(1320, 360)]), (12, []), (9, [(540, 540)])]], "t double, r array<struct<start_min:int,end_min:int>>")
    assert [r[0] for r in hours.select(G.active_at(F.col("t"), F.col("r"))).collect()] == [True, False, True, True, False, True, False]


CAL = {"near": {"foot_y": 0.9, "height": 0.6}, "far": {"foot_y": 0.5, "height": 0.3}}
SQUARE = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 1]]
CHILD, ADULT = (700, 550, 800, 900), (700, 320, 800, 900)


def zone_case(spark, zone, *rows):
    zones = spark.createDataFrame([zone_row("c", {"name": "z", "polygon": SQUARE, "calibration": CAL} | zone)], ZONE_SCHEMA)
    return sorted(r.det_id for r in zone_hits(spark.createDataFrame(list(rows), DET), zones).collect())


def test_zones(spark):
    assert zone_case(spark, {}, det(1, "Person", 0.9, CHILD), det(2, "person", 0.9, ADULT), det(3, "person", 0.3, CHILD), det(4, "dog", 0.9, CHILD)) == [1]
    assert zone_case(spark, {}, det(1, "person", 0.9, (100, 550, 200, 900)), det(2, "person", 0.9, CHILD, camera="x"), det(3, "person", 0.9, CHILD, size=(0, 0)), det(4, "person", 0.9, None)) == []
    assert zone_case(spark, {"calibration": None}, det(1, "person", 0.9, CHILD)) == []
    assert zone_case(spark, {"calibration": None, "child_filter": False}, det(1, "person", 0.9, ADULT)) == [1]
    assert zone_case(spark, {"child_filter": False}, det(1, "person", 0.9, (700, 550, 800, 995))) == []
    assert zone_case(spark, {"active_hours": ["01:00-02:00"]}, det(1, "person", 0.9, CHILD)) == []
    assert zone_case(spark, {"child_ratio": 1.2}, det(1, "person", 0.9, ADULT)) == [1]
    zones = spark.createDataFrame([zone_row("c", {"name": n, "polygon": SQUARE, "child_filter": False}) for n in "ab"], ZONE_SCHEMA)
    both = out_of_area(zone_hits(spark.createDataFrame([det(1, "person", 0.5, CHILD), det(2, "person", 0.8, CHILD)], DET), zones)).collect()
    assert sorted((r.zone, r.det_id, r.people_in_zone) for r in both) == [("a", 2, 2), ("b", 2, 2)]
    assert zone_hits(spark.createDataFrame([det(1, "person", 0.9, CHILD)], DET), spark.createDataFrame([], ZONE_SCHEMA)).count() == 0


def body(**parts):
    k = [(100.0, 100.0 + 10 * i, 0.9) for i in range(17)]
    for name, v in parts.items():
        k[int(name[1:])] = v
    return k


def test_poses(spark):
    cases = {
        "SAFE": body(), "WARNING": body(_9=(100.0, 50.0, 0.9)), "DANGER": body(_9=(100.0, 50.0, 0.9), _15=(100.0, 150.0, 0.9)), "NORMAL": body()[:16],
        "LYING": body(_5=(300.0, 205.0, 0.9), _6=(300.0, 205.0, 0.9), _9=(100.0, 50.0, 0.9)),
    }
    df = spark.createDataFrame(list(cases.items()), "want string, k array<struct<x:double,y:double,confidence:double>>")
    for r in df.select("want", P.pose_class(F.col("k")).alias("got")).collect():
        assert r.got == r.want
    unsure = spark.createDataFrame([(body(_9=(100.0, 50.0, 0.2)),), (None,), ([],)], "k array<struct<x:double,y:double,confidence:double>>")
    assert [r[0] for r in unsure.select(P.pose_class(F.col("k"))).collect()] == ["SAFE", "NORMAL", "NORMAL"]
    rows = spark.createDataFrame([det(1, "person", 0.5, kps=cases["DANGER"]), det(2, "person", 0.7, kps=cases["DANGER"]), det(3, "person", 0.9, kps=cases["WARNING"])], DET)
    assert [(r.det_id, r.people_at_risk) for r in climbing(rows).collect()] == [(2, 2)]
    assert [(r.det_id, r.people_at_risk) for r in climbing(rows, require_both=False).collect()] == [(3, 3)]


def scene(wrist, frames=20, left=100, right=310, conf=0.9, people=2):
    rows, n = [], 0
    for f in range(frames):
        for p, x in enumerate((left, right)[:people]):
            k = [(float(x + 100), 200.0, 0.9)] * 17
            k[9] = (float(wrist(f)), 250.0, 0.9) if p == 0 else (float(x + 100), 250.0, 0.9)
            k[10] = (float(x + 60), 250.0, 0.1)
            rows.append((n, "c", f, 100_000 + f * 100, p, "person", conf, (float(x), 100.0, float(x + 200), 500.0), k))
            n += 1
    return rows


FIGHT = f"det_id long, camera_id string, frame_index long, t_ms long, det_idx int, label string, confidence double, bbox {BOX}, keypoints array<struct<x:double,y:double,confidence:double>>"


def test_swings_against_a_loop():
    """The wrist table against keeping a list for each person."""
    import numpy as np

    rule = FightRule(samples=7)
    for seed in range(20):
        rng = np.random.default_rng(seed)
        crowd, kept, t = Crowd.nobody(rule.samples), [], 0.0
        for _ in range(60):
            t = round(t + rng.choice([0.05, 0.1, 0.3, 0.6]), 3)
            place = np.where(rng.random((1, 2, 1)) < 0.7, rng.integers(0, 300, (1, 2, 2)).astype(float), np.nan)
            crowd, seen = step(crowd, rule, np.array([[0.0, 0, 100, 200]]), place, t)
            kept = [k for k in kept if t - k[0] <= 1.0]
            now = {w: place[0, w] for w in (0, 1) if not np.isnan(place[0, w, 0])}
            old = [next((k[2] for k in kept[::-1] if k[1] == w), None) for w in (0, 1)]
            if len(now) == 2 and old[0] is not None and old[1] is not None:
                far = lambda a, b: np.hypot(*(now[a] - old[b]))  # noqa: B023, E731
                if far(0, 1) + far(1, 0) < far(0, 0) + far(1, 1):
                    now = {0: now[1], 1: now[0]}
            want = 0.0
            for w, xy in sorted(now.items()):
                kept = [*kept, (t, w, xy)][-rule.samples :]
            for w, xy in now.items():
                if ref := [k for k in kept if k[1] == w and t - k[0] >= 0.25]:
                    want = max(want, np.hypot(*(xy - ref[-1][2])) / 200 / (t - ref[-1][0]))
            assert np.isclose(seen.speed[0], want)


def swing(f):
    return 250 if f % 8 < 4 else 450


def test_blows(spark):
    run = lambda rows: fights(spark.createDataFrame(rows, FIGHT)).collect()
    hit = run(scene(swing))
    assert hit and all(r.wrist_speed >= 1.5 and r.track_ids == [1, 2] for r in hit)
    assert not run(scene(lambda f: 330)) and not run(scene(swing, right=900)) and not run(scene(swing, people=1)) and not run(scene(swing, conf=0.3))
    later = [(i + 1000, c, f + 500, t + 60_000, *rest) for i, c, f, t, *rest in scene(swing)]
    assert len(run(scene(swing) + later)) == 2 * len(hit)
    assert run(scene(swing)[:0]) == []


def test_tracker():
    import numpy as np

    rule, none = FightRule(), np.full((2, 2, 2), np.nan)
    box = lambda *xs: np.array([[x, 0, x + 100, 100] for x in xs], float)
    crowd, first = step(Crowd.nobody(60), rule, box(0, 500), none, 0.0)
    crowd, again = step(crowd, rule, box(505, 5), none, 0.1)
    assert first.track.tolist() == [1, 2] and again.track.tolist() == [2, 1] and again.unsure.tolist() == [False, False]
    _, late = step(crowd, rule, box(5), none[:1], 1.2)
    assert late.track.tolist() == [3]
    crowd, _ = step(Crowd.nobody(60), rule, box(0, 20), none, 0.0)
    assert step(crowd, rule, box(10, 12), none, 0.1)[1].unsure.tolist() == [True, True]


def walk(seed, frames=240, people=5):
    """People wandering, vanishing and coming back in view of one camera that is never empty for long."""
    rng, rows, t = random.Random(seed), [], 0
    at = [rng.uniform(0, 600) for _ in range(people)]
    for f in range(frames):
        t += rng.choice([40, 100, 100, 250, *([1500] if seed % 2 and f % 50 == 0 else [])])
        for p in range(people):
            at[p] += rng.uniform(-25, 25)
            if rng.random() < 0.9:
                x = round(at[p], 1)
                k = [(x + 100, 200.0, 0.9)] * 17
                k[9], k[10] = ((x + rng.uniform(-60, 260), 250.0, rng.choice([0.9, 0.9, 0.1])) for _ in range(2))
                rows.append((len(rows), "c", f, t, p, "person", 0.9, (x, 100.0, x + 200, 500.0), k))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_busy_camera_over_all_partitions(spark, seed):
    df = spark.createDataFrame(walk(seed), FIGHT).repartition(3)
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for width in ("1", "5", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", width)
            seen.append([sorted(map(repr, of(df).collect())) for of in (tracks, fights)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2] and all(seen[0])


def test_suppression(spark):
    df = spark.createDataFrame([det(1, "a", 0.9), det(2, "A", 0.8, (1, 1, 11, 11)), det(3, "b", 0.7), det(4, "a", 0.7, (50, 50, 60, 60)), det(5, "a", None), det(6, None, 0.5), det(7, "a", 0.9)], DET)
    got = suppress(df, ["camera_id", "frame_index"], F.lower("label"), "det_id", "confidence", "bbox", 0.3)
    assert sorted(r.det_id for r in got.collect()) == [1, 3, 4]


def test_hash_and_near(spark):
    a, b = list(range(72)), [71 - i for i in range(72)]
    df = spark.createDataFrame([(a,), (b,), (a[:5],)], "p array<int>")
    assert [r[0] for r in df.select(dhash(F.col("p"))).collect()] == [-1, 0, None]
    left = [(i, (i * 0x9E3779B97F4A7C15) % 2**63) for i in range(60)]
    right = [(100 + i, h ^ ((1 << (i % 9)) - 1)) for i, h in left] + [(99, left[0][1])]
    l, r = spark.createDataFrame(left, "id long, hash long"), spark.createDataFrame([*right, (98, None)], "id long, hash long")
    for bits in (0, 4, 7, 10, 17):
        want = {}
        for i, h in left:
            best = min(((bin(h ^ g).count("1"), j) for j, g in right), default=None)
            if best and best[0] <= bits:
                want[i] = best
        assert {x.id: (x.bits, x.near_id) for x in nearest(l, r, bits).collect()} == want
        assert {x.id for x in near_any(l, r, bits).collect()} == set(want)


def test_relocation_reaches_its_end(spark):
    rows = [(1, "t", "train", 0), (2, "a", "val", 1), (3, "a", "val", 0xFF00), (4, "b", "val", 0xFF01), (5, "c", "val", 0x7FFF0000)]
    got = relocate(spark.createDataFrame(rows, "id long, grp string, side string, hash long"), 2)
    assert {r.id: r.side for r in got.collect()} == {1: "train", 2: "train", 3: "train", 4: "train", 5: "val"}


def test_source_groups(spark):
    names = {"smoke_12_jpg.rf.0a.jpg": "smoke", "cam-a (3)_png.rf.1.png": "cam-a", "0012_jpg.rf.7.jpg": "<numeric-only>", "fire-jpeg": "fire", "gambar12_jpg.rf.x": "gambar"}
    df = spark.createDataFrame(list(names.items()), "n string, want string")
    for r in df.select("n", "want", source_group(F.col("n")).alias("got"), split_key(F.col("n")).alias("key")).collect():
        assert r.got == r.want
        assert r.key == (r.want if r.want not in ("<numeric-only>", "gambar") else "id:" + r.n.split("_jpg.rf.")[0])
    with pytest.raises(Exception, match="forbidden path"):
        refuse_paths(spark.createDataFrame([("a/eval/x",)], "p string"), "p", "eval").collect()


def test_clip_scores_and_gates(spark):
    clips = spark.createDataFrame([("p1", ["fight"], {"fight": 1}, 600.0), ("p2", ["fight"], {}, 600.0), ("n1", [], {"fight": 2}, 1800.0), ("n2", None, None, 1800.0)], "path string, expected array<string>, fired map<string,int>, duration_s double")
    s = clip_scores(clips).first()
    assert (s.event_type, s.tp, s.fn, s.fp_clips, s.neg_clips, s.fp_events, s.fp_per_hour) == ("fight", 1, 1, 1, 2, 2, 2.0)
    rows = [(f"d/fight_pos_s2_{i:02d}_staged.mp4", {"fight": 1} if i < 4 else {}, {}) for i in range(6)] + [(f"hazard_pos_s2_{i:02d}_gate.mp4", {}, {"scissors": 0.4 if i < 8 else 0.3}) for i in range(10)] + [(f"fight_neg_s2_{i}_daily.mp4", {}, {}) for i in range(9)]
    got = {r.gate: (r.clips, r.counted, r.status) for r in gate_status(spark.createDataFrame(rows, "path string, fired map<string,int>, max_conf map<string,double>"), available=["fight", "hazard_object"]).collect()}
    assert got == {0: (0, 0, "NOT RUN"), 1: (0, 0, "NOT RUN"), 2: (0, 0, "NOT RUN"), 3: (6, 4, "PASS"), 4: (9, 0, "CHECK"), 5: (10, 8, "PASS")}


def test_threshold_choice(spark):
    rows = [(1, True, 0.35 + i / 20) for i in range(9)] + [(1, True, 0.1)] + [(0, True, 0.3)] * 6 + [(0, True, 0.9)] * 4
    df = spark.createDataFrame(rows, "label int, det_fired boolean, cls_prob double")
    r = choose_threshold(threshold_sweep(df), 0.10).first()
    assert (r.threshold, r.tp, r.fp, r.base_fp, r.adopted) == (0.35, 9, 4, 10, True)
    flat = df.withColumn("cls_prob", F.lit(0.5))
    assert choose_threshold(threshold_sweep(flat), 0.05).first().adopted is False


def test_report(spark):
    n = "array<struct<channel:string,sent_at:double,success:boolean,error:string>>"
    ok, bad = [("console", 1.0, True, None)], [("line", 1.0, False, ""), ("mail", 1.0, False, "timeout")]
    rows = [("e1", "fight", "c", None, 100.0, 101.0, ok, 400), ("e2", "fight", "c", None, 110.0, 0.0, [], 30), ("e3", "fight", "c", None, 200.0, 201.0, bad, 10), ("e4", "fight", "c", "z", 205.0, None, None, 10), ("e5", "smoke", "c", None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"event_id string, event_type string, camera_id string, subject string, started_at double, confirmed_at double, notifications {n}, hit_count int")
    got = {r.event_id: (r.outcome, r.reason) for r in explain(df, {}, 30.0).collect()}
    assert got == {"e1": ("SENT", "console"), "e2": ("NOT SENT", "cooldown"), "e3": ("SEND FAILED", "line: failed; mail: timeout"), "e4": ("NOT SENT", "unknown"), "e5": ("NOT SENT", "unknown")}
    total = next(r for r in funnel(df).collect() if r.event_type == "ALL")
    assert (total.sightings, total.events, total.sent, total.failed, total.not_sent) == (450, 5, 1, 1, 3)


def test_routes(spark):
    routes = [Route.parse({"channels": ["console"], "event_types": "*"}), Route.parse({"channels": ["line", "console"], "event_types": ["fight"], "min_severity": "high"})]
    df = spark.createDataFrame([("fight", "HIGH"), ("fight", "low"), ("smoke", None)], "t string, s string")
    assert [r[0] for r in df.select(targets(F.col("t"), F.col("s"), routes, ["console", "line"])).collect()] == [["console", "line"], ["console"], []]
    assert [r[0] for r in df.select(targets(F.col("t"), F.col("s"), routes, [])).collect()] == [[], [], []]
    with pytest.raises(ValueError):
        Route.parse({"min_severity": "urgent"})
