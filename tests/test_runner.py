"""Modules that fail, channels that fail, sources that fail."""

import io
import itertools

import pytest
from pyspark.sql import functions as F

from sightline.operators.runner import Detector, LabelDetector, Module, PoseDetector, module_counts, run_modules
from sightline.sources.live import FrameSource, Reader, Retry, SourceLost, frames
from sightline.streaming.channels import PUSH_CHARS, ConsoleChannel, PushChannel, deliver, drain, sent, with_notifications
from sightline.streaming.lifecycle import joined_streams, session_counts


@pytest.fixture(scope="module", autouse=True)
def importable(spark):
    """The tests' own functions, for the workers."""
    spark.sparkContext.addPyFile(__file__)


def see(frame, labels, least):
    return [{"label": x, "confidence": c} for x, c in zip(frame["labels"], frame["confs"])]


class Broken(Detector):
    name = "broken"

    def process(self, frame):
        if frame["frame_index"] in (2, 3):
            raise ValueError("bad frame")
        return [{"label": "x", "confidence": 1.0}]


class Unloadable(Detector):
    name = "unloadable"

    def load(self):
        raise OSError("no weights")


def test_modules(spark):
    df = spark.createDataFrame([("c", i, ["Knife", "cup"], [0.9, 0.2]) for i in range(6)] + [("c", None, ["knife"], [0.1])], "camera_id string, frame_index long, labels array<string>, confs array<double>").repartition(2)
    alarm = lambda frame, found: [{"event_type": "hazard", "confidence": d["confidence"]} for d in found]
    pose = PoseDetector(lambda f, x, m: [{"label": "person", "confidence": 0.9, "keypoints": [1, 2]}], status=lambda k: f"{len(k)} points", every=3)
    modules = [Module(LabelDetector(see, ["KNIFE"], 0.5), alarm), Module(Broken(), alarm), Module(Unloadable()), Module(pose), Module(Detector(), name="unsaid")]
    ran = run_modules(df, modules)
    got = {r.module: (r.frames, r.errors, r.candidates) for r in module_counts(ran).collect()}
    assert got == {"labels": (7, 0, 6), "broken": (7, 2, 5), "unloadable": (7, 7, 0), "pose": (3, 0, 0), "unsaid": (7, 7, 0)}
    rows = ran.collect()
    assert {r.error for r in rows if r.module == "broken"} == {None, "ValueError: bad frame"} and {r.error for r in rows if r.module == "unloadable"} == {"OSError: no weights"}
    assert {d.attributes["pose_status"] for r in rows if r.module == "pose" for d in r.detections} == {"2 points"}
    assert run_modules(df.limit(0), modules).count() == 0 and run_modules(df, []).count() == 0


def test_channels():
    out = io.StringIO()
    assert ConsoleChannel(out)([{"text": "hello", "snapshot_path": "a.jpg"}]) == [(True, None)] and "hello\n(snapshot: a.jpg)" in out.getvalue()
    assert PushChannel(lambda *a: (200, ""))([{"text": "x"}]) == [(False, "credentials missing")]
    seen = []

    def post(token, to, text):
        seen.append(text)
        return next(answers)

    def down(*a):
        raise OSError("down")

    answers = iter([(200, ""), (401, " who "), (429, ""), (500, "x" * 999)])
    push = PushChannel(post, "t", "me")
    got = push([{"text": "y" * 9999}, {"text": "b"}, {"text": None}, {"text": "d"}])
    assert [s for s, _ in got] == [True, False, False, False] and got[1][1] == "401 unauthorized. who" and got[2][1] == "429 rate limited. (no body)" and got[3][1] == "HTTP 500. " + "x" * 200
    assert len(seen[0]) == PUSH_CHARS and PushChannel(down, "t", "me").send("a") == (False, "OSError: down")


def test_delivery(tmp_path, spark):
    def broken(rows):
        raise OSError("down")

    box = spark.createDataFrame([("e", "a", "t"), ("e", "b", "t"), ("e", "c", "t")], "event_id string, channel string, text string")
    channels = {"a": lambda rows: [(True, None)] * len(rows), "b": broken}
    run = deliver(channels, str(tmp_path / "d"))
    run(box, 0)
    read = lambda: sorted((r.batch_id, r.channel, r.success, r.error) for r in spark.read.parquet(str(tmp_path / "d")).collect())
    first = [(0, "a", True, None), (0, "b", False, "OSError: down"), (0, "c", False, "not configured")]
    assert read() == first
    run(box, 0)  # the same batch again
    assert read() == first
    run(box, 1)  # what has reached a channel isn't sent again
    assert read() == [*first, (1, "b", False, "OSError: down"), (1, "c", False, "not configured")]
    events = spark.createDataFrame([("e", None), ("f", None)], "event_id string, notifications array<struct<channel:string,sent_at:double,success:boolean,error:string>>")
    saved = with_notifications(events, spark.read.parquet(str(tmp_path / "d"))).collect()
    assert [r.event_id for r in saved] == ["e"] and len(saved[0].notifications) == 5
    assert sent(box.limit(0), channels).count() == 0


def test_outbox_stream(tmp_path, spark):
    spark.createDataFrame([(f"e{i}", "a", "t") for i in range(5)], "event_id string, channel string, text string").coalesce(1).write.parquet(str(tmp_path / "box"))
    stream = spark.readStream.schema("event_id string, channel string, text string").parquet(str(tmp_path / "box"))
    q = stream.writeStream.foreachBatch(deliver({"a": lambda rows: [(True, None)] * len(rows)}, str(tmp_path / "d"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        drain(q, 1.0)
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "d")).count() == 5


class Device:
    def __init__(self, results):
        self.results, self.released = results, 0

    def read(self):
        r = next(self.results)
        if isinstance(r, Exception):
            raise r
        return r

    def release(self):
        self.released += 1


def test_retries():
    naps, opened = [], []
    results = itertools.chain([{"n": 0}], [None, OSError("x")] * 6, [{"n": 1}], itertools.repeat(None))

    def open_(source):
        opened.append(source)
        return Device(results)

    r = Reader(open_, "rtsp://x", True, Retry(50, 10, 0.1), naps.append)
    assert r.read() == {"n": 0} and r.read() == {"n": 1}
    assert len(opened) == 2 and len(naps) == 12  # opened again after ten failures
    with pytest.raises(SourceLost):
        r.read()
    assert len(opened) == 2 + 4
    f = Reader(lambda s: Device(iter([{"n": 0}, None])), "a.mp4", False)
    assert f.read() == {"n": 0} and f.read() is None


def open_by_name(source):
    if source == "closed":
        raise OSError("can't open")
    n = {"short": 2, "backup": 3, "lost": 2}[source]
    end = itertools.repeat(None) if source == "lost" else iter([None])
    return Device(itertools.chain(({"content": f"{source}{i}".encode()} for i in range(n)), end))


def test_backup_takes_over_once():
    retry = Retry(3, 10, 0.0)
    names = lambda *a: [(f["source"], f["frame_index"], f["is_backup"]) for f in frames(open_by_name, *a, retry=retry)]
    assert names("short", False, "backup") == [("short", 0, False), ("short", 1, False)]
    assert names("closed", True, "backup") == [("backup", i, True) for i in range(3)]
    assert names("lost", True, "backup") == [("lost", 0, False), ("lost", 1, False), ("backup", 2, True), ("backup", 3, True), ("backup", 4, True)]
    for source, backup in (("closed", None), ("closed", "closed")):
        with pytest.raises(OSError):
            names(source, True, backup)
    with pytest.raises(SourceLost):
        names("lost", True, None)


def test_frame_source(spark, tmp_path):
    spark.dataSource.register(FrameSource)
    read = spark.read.format("sightline_frames").option("opener", "test_runner:open_by_name").option("live", "true").option("mostFailures", 3).option("delayS", 0)
    got = read.option("backup", "backup").option("path", "lost,closed").load()
    assert sorted((r.source, r.frame_index, r.is_backup) for r in got.collect()) == sorted([("lost", 0, False), ("lost", 1, False), *(("backup", i, True) for i in (2, 3, 4)), *(("backup", i, True) for i in range(3))])
    assert read.option("backup", "backup").option("path", "closed").option("maxFrames", 2).load().count() == 2
    (tmp_path / "shots").mkdir()
    for k in "abc":
        (tmp_path / "shots" / f"{k}.jpg").write_bytes(k.encode())
    stream = spark.readStream.format("sightline_frames").option("opener", "sightline.sources.live:open_files").option("path", str(tmp_path / "shots")).option("step", 2).load()
    q = stream.writeStream.format("memory").queryName("live_frames").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.frame_index, bytes(r.content)) for r in spark.table("live_frames").orderBy("frame_index").collect()] == [(0, b"a"), (1, b"b"), (2, b"c")]


def test_session_windows_and_joined_streams(spark, tmp_path):
    rows = [("c", "x", 0.5, 0), ("c", "x", 0.7, 5), ("c", "x", 0.1, 30), ("d", "x", 0.2, 5)]
    df = spark.createDataFrame(rows, "camera_id string, label string, confidence double, s long").withColumn("event_time", F.timestamp_seconds("s"))
    assert sorted((r.camera_id, r.n, r.best) for r in session_counts(df).collect()) == [("c", 1, 0.1), ("c", 2, 0.7), ("d", 1, 0.2)]
    df.select(F.concat("camera_id", F.col("s").cast("string")).alias("event_id"), "event_time").coalesce(1).write.parquet(str(tmp_path / "e"))
    df.where("camera_id = 'c' AND s = 5").select(F.lit("c5").alias("event_id"), (F.col("event_time") + F.expr("INTERVAL 3 seconds")).alias("sent_at"), F.lit("line").alias("channel")).coalesce(1).write.parquet(str(tmp_path / "r"))
    events = spark.readStream.schema("event_id string, event_time timestamp").parquet(str(tmp_path / "e"))
    records = spark.readStream.schema("event_id string, sent_at timestamp, channel string").parquet(str(tmp_path / "r"))
    q = joined_streams(events, records).writeStream.format("memory").queryName("joined").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.event_id, r.channel) for r in spark.table("joined").collect()] == [("c5", "line")]
