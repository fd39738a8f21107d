"""Configuration, readers and writers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from sightline import config as C
from sightline.sources import event_log, files, media


def test_config(tmp_path, spark):
    with pytest.raises(FileNotFoundError):
        C.load_config(tmp_path / "no.json")
    p = tmp_path / "c.json"
    p.write_text('{"default": {"cooldown_s": 20}, "types": {"smoke": {"cooldown_s": 60, "severity": "HIGH"}}}')
    base, types = C.event_rules(C.load_config(p))
    assert (base.cooldown_s, types["smoke"].cooldown_s, types["smoke"].confirm_hits) == (20, 60, 3)
    assert C.parse_hours("22:00-06:00") == (1320, 360)
    for bad in ("9-10", "24:00-01:00", "aa:00-01:00", "09:60-10:00"):
        with pytest.raises(ValueError):
            C.parse_hours(bad)
    with pytest.raises(ValueError):
        C.zone_row("c", {"name": "z", "polygon": [[0, 0], [1, 1]]})
    with pytest.raises(ValueError):
        C.zone_row("c", {"name": "z", "polygon": [[0, 0], [1, 1], [2, 0]]})
    z = tmp_path / "z.json"
    assert C.load_zones(spark, z).count() == 0
    C.save_zone(z, "c", {"name": "a", "polygon": [[0, 0], [1, 0], [0.123456, 1]]})
    C.save_zone(z, "c", {"name": "b", "polygon": [[0, 0], [1, 0], [1, 1]]})
    C.save_zone(z, "c", {"name": "a", "polygon": [[0, 0], [1, 0], [0.5, 1]], "active_hours": ["01:00-02:00"]})
    got = {r.zone: r for r in C.load_zones(spark, z).collect()}
    assert set(got) == {"a", "b"} and got["a"].polygon[2].x == 0.5 and got["a"].active[0].end_min == 120
    assert C.routes({"channels": {"line": {"enabled": False}}, "routes": [{"channels": ["line"]}]})[1] == ["console"]
    mods = [{"name": "a"}, {"name": "b", "enabled": False}]
    assert [m["name"] for m in C.selected(mods)] == ["a"] and [m["name"] for m in C.selected(mods, ["b"])] == ["b"]
    with pytest.raises(ValueError):
        C.selected(mods, ["c"])
    assert C.class_ids({0: "Person", 3: "smoke"}, ["SMOKE"]) == [3]
    with pytest.raises(ValueError):
        C.class_ids({0: "Person"}, ["smoke"])
    rule = C.build({"class": "sightline.operators.policies:LabelRule", "params": {"event_type": "x", "labels": ("a",)}})
    assert rule.event_type == "x"
    with pytest.raises(TypeError):
        C.build("sightline.operators.policies:LabelRule", dict)
    assert C.calibration_point((5, 100), (5, 600), 1000) == (0.6, 0.5)
    with pytest.raises(ValueError):
        C.check_calibration((0.6, 0.3), (0.58, 0.2))
    assert C.snap(0.985) == 1.0 and C.snap(0.5) == 0.5 and C.clamp(0.777, 0, 0.5) == 0.5


def test_labels_and_results(tmp_path, spark):
    (tmp_path / "l.csv").write_text('path,split,expected,note\na.mp4,tune,"fight;none; smoke",\n/x/b.mp4,test ,none,n\n')
    got = sorted(tuple(r) for r in files.read_labels(spark, str(tmp_path / "l.csv")).collect())
    assert got == sorted([("/x/b.mp4", "test", [], "n"), (f"{tmp_path}/a.mp4", "tune", ["fight", "smoke"], "")])
    back = files.labels_for_csv(files.read_labels(spark, str(tmp_path / "l.csv")))
    files.write_csv(back.coalesce(1), str(tmp_path / "out"))
    assert sorted(r.expected for r in files.read_labels(spark, str(tmp_path / "out")).collect()) == [[], ["fight", "smoke"]]
    row = ",".join({"object": "scissors", "distance_m": "1.5", "confidence": "0.45"}.get(c, "") for c in files.RESULT_COLUMNS)
    (tmp_path / "r.csv").write_text(",".join(files.RESULT_COLUMNS) + "\n" + row + "\n" + row.replace("0.45", "").replace("1.5", "far") + "\n")
    res = files.read_results(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in files.gate_counts(res).collect()] == [("scissors", 1, 1)]
    frames = spark.createDataFrame([(1, [("a", 0.456, None)]), (2, [])], "f long, detections array<struct<label:string,confidence:double,bbox:struct<x1:double>>>")
    assert sorted((r.f, r.label, r.confidence, r.missed) for r in files.result_rows(frames).collect()) == [(1, "a", "0.46", False), (2, "", "", True)]


def test_thresholds_and_reports(tmp_path, spark):
    files.save_threshold(str(tmp_path / "t.json"), 0.35, {"split": "Validation"})
    assert files.load_threshold(str(tmp_path / "t.json")) == 0.35
    with pytest.raises(ValueError):
        files.load_threshold(str(tmp_path / "t.json"), "Testing")
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert files.markdown(df, "T").splitlines()[-1] == "| a\\|b | - |"
    with pytest.raises(ValueError):
        files.markdown(df, "T", 0)


def test_trees_and_archives(tmp_path, spark):
    for s, n, text in (("train", "a", "1 .1 .2 .3 .4\n2 x\n"), ("valid", "b", None)):
        (tmp_path / "t" / s / "images").mkdir(parents=True)
        (tmp_path / "t" / s / "labels").mkdir()
        (tmp_path / "t" / s / "images" / f"{n}.jpg").write_bytes(b"x")
        if text:
            (tmp_path / "t" / s / "labels" / f"{n}.txt").write_text(text)
    got = sorted((r.split, r.name, r.lines) for r in files.label_tree(spark, str(tmp_path / "t")).collect())
    assert got == [("train", "a.jpg", ["1 .1 .2 .3 .4", "2 x"]), ("valid", "b.jpg", [])]
    assert media.images(spark, str(tmp_path / "t"), "*.jpg").select("sha256").distinct().count() == 1
    assert files.pack_zip(str(tmp_path / "t"), str(tmp_path / "a.zip"), "secret") == 3
    with pytest.raises(ValueError):
        files.pack_zip(str(tmp_path / "t"), str(tmp_path / "b.zip"), "train")
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert len(z.namelist()) == 3
    assert files.zip_members(spark, str(tmp_path / "a.zip"), 3).count() == 3 and files.zip_members(spark, str(tmp_path / "a.zip"), 2).count() == 0
    files.write_sides(spark.createDataFrame([(1, "val")], "id int, side string"), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_sides(spark.createDataFrame([(1, "val")], "id int, side string"), str(tmp_path / "s"))


def test_event_log(tmp_path, spark):
    schema = "event_id string, version long, event_type string, started_at double, status string"
    path = str(tmp_path / "log")
    event_log.append(spark.createDataFrame([("a", 1, "fight", 10.0, "CONFIRMED"), ("b", 1, "smoke", 90000.0, "CONFIRMED")], schema), path)
    event_log.append(event_log.with_json(spark.createDataFrame([("a", 2, "fight", 10.0, "CLOSED")], schema)).drop("data_json"), path)
    assert {r.event_id: r.status for r in event_log.read(spark, path).collect()} == {"a": "CLOSED", "b": "CONFIRMED"}
    assert event_log.get(spark, path, "a").first().version == 2
    assert [r.event_id for r in event_log.latest(spark, path, 1).collect()] == ["b"] and event_log.latest(spark, path, 5, "fight").count() == 1


def test_sources(spark):
    a, none = spark.createDataFrame([(1,)], "frame_index long"), spark.createDataFrame([], "frame_index long")
    assert not media.with_backup(a, a).first().is_backup and media.with_backup(none, a).first().is_backup
    assert sorted(r[0] for r in media.looped(a, 3, 10).collect()) == [1, 11, 21]
    kinds = spark.createDataFrame([("0",), ("rtsp://x",), ("A.JPG",), ("v.mp4",), (None,)], "s string").select(media.source_kind(F.col("s")))
    assert [r[0] for r in kinds.collect()] == ["webcam", "stream", "image", "video", None]


def test_hash_guard(tmp_path, spark):
    import hashlib

    (tmp_path / "w.pt").write_bytes(b"weights")
    good = hashlib.sha256(b"weights").hexdigest()
    files_ = media.images(spark, str(tmp_path), "*.pt")
    assert media.verified(files_, good.upper()).count() == 1
    with pytest.raises(Exception, match="hash differs"):
        media.verified(files_, "0" * 64).collect()
    with pytest.raises(ValueError):
        media.verified(files_, "")


def test_reports_and_sets(tmp_path, spark):
    from sightline.operators import preflight
    from sightline.operators.dataset import assert_disjoint
    from sightline.operators.evaluate import clip_scores, first_and_more, gate_status, of_split, overall
    from sightline.operators.report import explain, funnel
    from sightline.sources import reports

    clips = spark.createDataFrame([("a/fight_pos_s2_01_x.mp4", "test", ["fight"], {"fight": 1}, 60.0, 10, {}), ("a/n.mp4", "tune", None, None, 30.0, 5, {})], "path string, split string, expected array<string>, fired map<string,int>, duration_s double, frames int, max_conf map<string,double>")
    table, summary = reports.write_clip_report(clips, clip_scores(clips), gate_status(clips.where("split = 'test'"), available=["fight"]), str(tmp_path), "run", ["one note"])
    assert sorted((r.clip, r.expected, r.fired, r.duration_s) for r in spark.read.csv(table, header=True).collect()) == [("fight_pos_s2_01_x.mp4", "fight", "fight:1", "60.0"), ("n.mp4", "none", "none", "30.0")]
    text = open(summary).read()
    assert "- clips: 2, video time 1.5 min" in text and "| fight | 1/1 |" in text and "INCOMPLETE" in text
    log = spark.createDataFrame([("e1", "fight", "c", None, 100.0, 101.0, 103.5, [("line", 1.0, True, None)], 4, 0.905, "x", "s/a.jpg")], "event_id string, event_type string, camera_id string, subject string, started_at double, confirmed_at double, last_seen_at double, notifications array<struct<channel:string,sent_at:double,success:boolean,error:string>>, hit_count int, peak_confidence double, peak_label string, snapshot_path string")
    table, md = reports.write_event_report(log, explain(log, {}, 30.0), funnel(log), str(tmp_path), "test")
    assert [(r.seconds_seen, r.peak, r.snapshot) for r in spark.read.csv(table, header=True, schema=None).collect()] == [("3.5", "0.91", "a.jpg")] and "| fight | 4 | 1 | 1 | 0 | 0 |" in open(md).read()

    items = spark.createDataFrame([("train", "a.jpg", b"1", ["0 1 1 1 1"]), ("val", "b.png", b"2", None)], "side string, name string, content binary, lines array<string>")
    report = reports.write_image_set(items, str(tmp_path / "set"), ["smoke"], {"seed": 0})
    assert report["train"] == {"images": 1, "positives": 1, "negatives": 0, "boxes": 1} and (tmp_path / "set/val/labels/b.txt").read_text() == "" and (tmp_path / "set/train/labels/a.txt").read_text() == "0 1 1 1 1\n"
    assert "0: smoke" in (tmp_path / "set/data.yaml").read_text() and "seed" in (tmp_path / "set/build_info.json").read_text()
    with pytest.raises(FileExistsError):
        reports.write_image_set(items, str(tmp_path / "set"), ["smoke"])
    reports.write_record(str(tmp_path / "train.json"), {"epochs": 3})
    with pytest.raises(FileExistsError):
        reports.write_record(str(tmp_path / "train.json"), {})
    shots = spark.createDataFrame([("e", "x/s.jpg", b"1"), ("f", "g.jpg", None)], "event_id string, name string, content binary")
    assert {r.event_id: r.error is None for r in reports.write_snapshots(shots, str(tmp_path / "shots")).collect()} == {"e": True, "f": False} and (tmp_path / "shots/x/s.jpg").read_bytes() == b"1"

    checks = {"weights": preflight.weights_present(str(tmp_path / "no.pt")), "zones": preflight.zones_calibrated([{"name": "z"}]), "login": preflight.credentials_present({"token": ""}), "disk": preflight.storage_writable(str(tmp_path / "d"), 1), "source": preflight.source_opens(lambda: [1]), "model": preflight.model_runs(lambda f: 1 / 0)}
    rows = preflight.run_checks(spark, checks)
    assert [r.status for r in rows.orderBy("at").collect()] == ["FAIL", "WARN", "WARN", "OK", "OK", "FAIL"] and preflight.any_failed(rows).first()[0] == 1 and preflight.any_failed(rows.where("status = 'OK'")).first()[0] == 0
    results = spark.createDataFrame([("a", "PASS"), ("b", "INCOMPLETE")], "k string, status string")
    assert overall(results).first().overall == "FAIL" and overall(results.limit(1)).first().overall == "PASS"
    names = spark.createDataFrame([(f"n{i:02}",) for i in range(12)], "name string")
    assert [r.line for r in first_and_more(names, "name", 10).collect()][-1] == "... 2 more" and first_and_more(names, "name", 12).count() == 12
    assert of_split(clips, "tune").count() == 1 and of_split(clips, "all").count() == 2
    with pytest.raises(ValueError):
        of_split(clips, "train")
    assert assert_disjoint(spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "val")], "grp string, side string")).collect()[0].grp == "a"
    assert [tuple(r) for r in files.unique_names(spark.createDataFrame([("a",), ("a",), ("b",)], "name string"), "name").collect()] == [("a", 2)]
    off = C.for_evaluation({"channels": {"line": {"enabled": True, "to": "x"}}, "routes": []})
    assert off["channels"] == {"console": {"enabled": False}, "line": {"enabled": False, "to": "x"}} and C.routes(off)[1] == []
    made, errors = C.run_policies(names, {"good": lambda d: d.limit(1), "bad": lambda d: d.select("nothing")})
    assert set(made) == {"good"} and "bad" in errors


def test_scans(tmp_path, spark):
    for name in ("a/x.jpg", "a/b/Y.PNG", "notes.txt", "a/clip_1.mp4"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"1")
    got = {r.name: r.good for r in files.listed(spark, str(tmp_path / "in"), (".mp4",), "clip_").collect()}
    assert got == {"x.jpg": False, "Y.PNG": False, "notes.txt": False, "clip_1.mp4": True}
    assert sorted(r.name for r in files.negatives(spark, str(tmp_path / "in")).collect()) == ["neg__a__b__Y.PNG", "neg__a__x.jpg"]
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for name in ("d/train/images/a.jpg", "d/test/images/b.jpg", "readme"):
            z.writestr(name, b"7")
    members = {r.name: r.content for r in files.zip_members(spark, str(tmp_path / "s.zip"), 4, "test").collect()}
    assert members == {"d/train/images/a.jpg": b"7", "d/test/images/b.jpg": None}
