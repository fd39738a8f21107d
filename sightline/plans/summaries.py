"""Overall results, selections, tags, messages and rates beside the main queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.text import clip_start, hundredths, moment, one_decimal, to_ms
from sightline.operators.dataset import grouped_split
from sightline.operators.evaluate import first_and_more, of_split, overall, rolling, split_counts
from sightline.operators.runner import Detector, LabelDetector, Module, module_counts, run_modules
from sightline.operators.tracking import tracks
from sightline.operators.ordered import global_rank
from sightline.plans.dataset import _PREFLIGHT_SQL, _SPLIT_SQL, preflight, repeated_paths, staged_people
from sightline.plans.detections import _ONCE, detections
from sightline.plans.evaluate import _RUNS, _TRIALS_SQL, _runs, timed_trials
from sightline.sources.tables import table
from sightline.streaming.lifecycle import session_counts

DAY = "2026-01-05"


def trial_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cameras' trials as one result: passed only if each camera passed."""
    return overall(timed_trials(spark, sf_dir).select("camera_id", "status").distinct())


def preflight_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the set-up as one result: failed if any failed."""
    p = preflight(spark, sf_dir)
    return p.agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "WARN").alias("warnings"), F.count_if(F.col("status") == "FAIL").alias("failures"), F.bool_or(F.col("status") == "FAIL").alias("any_fail"))


def split_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per side of a split: pictures, boxes, groups and pictures per source."""
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("grp"), (F.col("doc_id") % 7 == 0).alias("flag"))
    split = grouped_split(items).withColumns({"boxes": F.when(F.col("flag"), F.col("id") % 4 + 1).otherwise(0), "origin": F.split("grp", "/")[0]})
    return split_counts(split, ["mail", "wiki", "shiftlog"])


def clips_of_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips that each selector of a run takes."""
    c = table(spark, sf_dir, "clips")
    parts = [of_split(c, which).select(F.lit(which).alias("selector"), "clip_id") for which in ("tune", "test", "all")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def rolling_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames a second over the last 30 frames of a run, at each frame."""
    r = rolling(_runs(spark, sf_dir), ["run_id", "detector"], "v")
    return r.select("run_id", "detector", "pos", F.when(F.col("total") > 0, F.col("n") / (F.col("total") / F.lit(10000.0))).otherwise(F.lit(0.0)).alias("fps"))


_FPS = """e AS (SELECT run_id, detector, unnest(v) AS x, unnest(range(len(v))) AS pos FROM vals WHERE len(v) > 0),
f AS (SELECT run_id, detector, pos, CASE WHEN sum(x) OVER w > 0 THEN count(*) OVER w / (sum(x) OVER w / 10000.0::DOUBLE) ELSE 0.0 END AS fps, sum(x) OVER (PARTITION BY run_id, detector ORDER BY pos) AS total FROM e WINDOW w AS (PARTITION BY run_id, detector ORDER BY pos ROWS 29 PRECEDING))"""


def degradation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's rolling speed at the first frame of each further second, and whether it is a tenth below the first sample."""
    every = 10_000  # tenths of a millisecond
    frames = _runs(spark, sf_dir).select("run_id", "detector", F.posexplode("v").alias("pos", "x"))
    run = Window.partitionBy("run_id", "detector").orderBy("pos")  # a run is one row of the table
    last = run.rowsBetween(-29, 0)
    f = frames.withColumns({"total": F.sum("x").over(run.rowsBetween(Window.unboundedPreceding, 0)), "sum": F.sum("x").over(last), "n": F.count("*").over(last)})
    f = f.withColumns({"fps": F.when(F.col("sum") > 0, F.col("n") / (F.col("sum") / F.lit(10000.0))).otherwise(F.lit(0.0)), "sample": F.floor(F.col("total") / every)}).where("sample >= 1")
    one = f.groupBy("run_id", "detector", "sample").agg(F.min_by("fps", "pos").alias("fps"))
    first = one.groupBy("run_id", "detector").agg(F.min_by("fps", "sample").alias("first_fps"))
    return one.join(first, ["run_id", "detector"]).withColumn("degraded", F.col("fps") < F.col("first_fps") * 0.9)


_SAMPLES_SQL = f"""WITH {_RUNS}, {_FPS}, s AS (SELECT run_id, detector, (total // 10000)::BIGINT AS sample, arg_min(fps, pos) AS fps FROM f WHERE total >= 10000 GROUP BY ALL)
SELECT *, first_value(fps) OVER w AS first_fps, fps < first_value(fps) OVER w * 0.9::DOUBLE AS degraded FROM s WINDOW w AS (PARTITION BY run_id, detector ORDER BY sample)"""


def compare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detector found in a frame, as one side of a comparison: how many, the surest one's confidence and area."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "detector", "confidence", "bbox").where("camera_id IS NOT NULL AND confidence IS NOT NULL AND bbox IS NOT NULL")
    area = (F.col("bbox.x2").cast("int") - F.col("bbox.x1").cast("int")) * (F.col("bbox.y2").cast("int") - F.col("bbox.y1").cast("int"))
    one = d.groupBy("camera_id", "frame_index", "detector").agg(F.count("*").alias("n"), F.max(F.struct("confidence", (-F.col("det_id")).alias("o"), area.alias("area"))).alias("r"))
    line = F.concat("detector", F.lit(": "), F.col("n").cast("string"), F.lit(" det, conf "), hundredths(F.col("r.confidence")), F.lit(", "), F.col("r.area").cast("string"), F.lit("px"))
    return one.select("camera_id", "frame_index", "detector", line.alias("line"))


_HUNDREDTHS = "((floor({0} * 100 + 0.5::DOUBLE)::BIGINT // 100) || '.' || lpad((floor({0} * 100 + 0.5::DOUBLE)::BIGINT % 100)::VARCHAR, 2, '0'))"
_COMPARE_SQL = (
    "WITH "
    + _ONCE
    + f""", r AS (SELECT *, count(*) OVER (PARTITION BY camera_id, frame_index, detector) AS n, (trunc(bbox.x2)::INT - trunc(bbox.x1)::INT) * (trunc(bbox.y2)::INT - trunc(bbox.y1)::INT) AS area FROM once WHERE camera_id IS NOT NULL AND confidence IS NOT NULL AND bbox IS NOT NULL)
SELECT camera_id, frame_index, detector, detector || ': ' || n || ' det, conf ' || {_HUNDREDTHS.format("confidence")} || ', ' || area || 'px' AS line FROM r
QUALIFY row_number() OVER (PARTITION BY camera_id, frame_index, detector ORDER BY confidence DESC, det_id) = 1"""
)


def person_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tracker writes beside each person of the staged scenes: track and wrist speed."""
    return tracks(staged_people(spark, sf_dir)).select("det_id", F.concat(F.lit("id"), F.col("track").cast("string"), F.lit(" spd "), one_decimal(F.col("speed"))).alias("tag"))


_TAGS_SQL = """WITH f AS (SELECT camera_id, regexp_extract(camera_id, '([0-9]+)', 1)::INT AS n, unnest(range(40)) AS frame_index FROM cameras),
x AS (SELECT *, (CASE n % 5 WHEN 2 THEN 350 WHEN 3 THEN CASE WHEN frame_index % 8 < 4 THEN 110 ELSE 280 END WHEN 4 THEN 250 + 10 * (frame_index % 20) ELSE CASE WHEN frame_index % 8 < 4 THEN 250 ELSE 450 END END)::DOUBLE AS x FROM f),
s AS (SELECT n, frame_index, coalesce(abs(x - lag(x, 3) OVER (PARTITION BY camera_id ORDER BY frame_index)) / 400 / (frame_index / 10.0::DOUBLE - (frame_index - 3) / 10.0::DOUBLE), 0) AS speed FROM x),
t AS (SELECT n::BIGINT * 1000 + frame_index * 2 AS det_id, 'id1 spd ' AS a, floor(speed * 10 + 0.5::DOUBLE)::BIGINT AS v FROM s UNION ALL SELECT n::BIGINT * 1000 + frame_index * 2 + 1, 'id2 spd ', 0 FROM s)
SELECT det_id, a || (v // 10) || '.' || (v % 10) AS tag FROM t"""


def first_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paths that are registered more than once, and how many more there are."""
    return first_and_more(repeated_paths(spark, sf_dir), "path", 5)


def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 frames of each camera: the cap of a run."""
    f = detections(spark, sf_dir, "camera_id", "frame_index").where("camera_id IS NOT NULL AND frame_index IS NOT NULL").select("camera_id", "frame_index").distinct()
    return global_rank(f, ["camera_id"], ["frame_index"]).where("rank <= 20").drop("rank")


def dataset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sets with unlike fields as one: pictures of clips and of cameras; a missing field is NULL."""
    clips = table(spark, sf_dir, "clips").select(F.lit("clips").alias("origin"), "path", "split", "frames")
    cameras = table(spark, sf_dir, "cameras").select(F.lit("cameras").alias("origin"), F.col("camera_id").alias("path"), "width", "height")
    return clips.unionByName(cameras, allowMissingColumns=True)


def hazard_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message of a frame with hazards: that of the surest one."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts", "label", "confidence").where("camera_id IS NOT NULL AND ts IS NOT NULL AND confidence IS NOT NULL").where(F.lower("label").isin("knife", "scissors"))
    top = d.groupBy("camera_id", "frame_index").agg(F.max(F.struct("confidence", (-F.col("det_id")).alias("o"), "label", "ts")).alias("r"))
    text = F.concat(F.lit("type: "), "r.label", F.lit("\nconfidence: "), hundredths(F.col("r.confidence")), F.lit("\ntime: "), moment(F.col("r.ts"), "dd/MM/yyyy HH:mm:ss"), F.lit("\ncamera: "), "camera_id")
    return top.select("camera_id", "frame_index", text.alias("text"))


_HAZARD_SQL = (
    "WITH "
    + _ONCE
    + f""" SELECT camera_id, frame_index, 'type: ' || label || chr(10) || 'confidence: ' || {_HUNDREDTHS.format("confidence")} || chr(10) || 'time: ' || strftime(make_timestamp(floor(ts)::BIGINT * 1000000), '%d/%m/%Y %H:%M:%S') || chr(10) || 'camera: ' || camera_id AS text
FROM once WHERE camera_id IS NOT NULL AND ts IS NOT NULL AND confidence IS NOT NULL AND lower(label) IN ('knife', 'scissors') QUALIFY row_number() OVER (PARTITION BY camera_id, frame_index ORDER BY confidence DESC, det_id) = 1"""
)


def clip_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock at which each clip is made to start, so that hours of zones can be tried out."""
    c = table(spark, sf_dir, "clips").select("clip_id").distinct()
    hhmm = F.concat(F.lpad((F.col("clip_id") % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("clip_id") % 60).cast("string"), 2, "0"))
    return c.select("clip_id", clip_start(F.lit(DAY), hhmm).alias("start"))


def report_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of the event log as a report shows them."""
    return table(spark, sf_dir, "event_log").select("log_seq", *(moment(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started_at", "confirmed_at", "closed_at")))


def _moment_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN '-' ELSE strftime(make_timestamp(floor({c})::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') END AS {c}"


def label_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections per camera and label in sessions of event time that end after ten seconds."""
    d = detections(spark, sf_dir, "camera_id", "label", "confidence", "ts").where("camera_id IS NOT NULL AND ts IS NOT NULL")
    timed = d.select("camera_id", "label", "confidence", F.timestamp_millis(to_ms(F.col("ts"))).alias("event_time"))
    return session_counts(timed).select("camera_id", "label", F.unix_millis("session_window.start").alias("start_ms"), "n", "best")


_SESSIONS_SQL = (
    "WITH "
    + _ONCE
    + """, a AS (SELECT camera_id, label, confidence, round(ts * 1000)::BIGINT AS t FROM once WHERE camera_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY camera_id, label ORDER BY t) <= 10000 THEN 0 ELSE 1 END AS fresh FROM a),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_id, label ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM b)
SELECT camera_id, label, min(t) AS start_ms, count(*) AS n, max(confidence) AS best FROM c GROUP BY camera_id, label, s"""
)


class _Given(Detector):
    """A detector whose detections come with the frame, and that refuses frames with a confidence out of range."""

    name = "strict"

    def process(self, frame: dict) -> list[dict]:
        found = [{"label": d["label"], "confidence": d["confidence"]} for d in frame["boxes"]]
        if any(d["confidence"] is None or d["confidence"] > 1 for d in found):
            raise ValueError("confidence out of range")
        return found


def _shown(frame: dict, labels: object, least: float) -> list[dict]:
    return [{"label": d["label"], "confidence": d["confidence"]} for d in frame["boxes"]]


def _one_each(frame: dict, found: list[dict]) -> list[dict]:
    return [{"event_type": d["label"], "confidence": d["confidence"]} for d in found]


def _no_third(frame: dict, found: list[dict]) -> list[dict]:
    if len(found) > 2:
        raise RuntimeError("too many")
    return []


def module_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, errors and candidates of three modules over all frames, two of which fail on some."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "label", "confidence").where("camera_id IS NOT NULL")
    frames = d.groupBy("camera_id", "frame_index").agg(F.collect_list(F.struct("label", "confidence")).alias("boxes"))
    modules = [Module(LabelDetector(_shown, ["knife", "scissors"], 0.4, name="hazard"), _one_each), Module(_Given()), Module(LabelDetector(_shown, name="crowd", every=3), _no_third)]
    return module_counts(run_modules(frames, modules))


_MODULES_SQL = (
    "WITH "
    + _ONCE
    + """, f AS (SELECT camera_id, frame_index, count(*) AS n, bool_or(confidence IS NULL OR confidence > 1) AS bad, count(*) FILTER (WHERE lower(label) IN ('knife', 'scissors') AND confidence >= 0.4::DOUBLE) AS c, count(*) FILTER (WHERE coalesce(confidence, 0) >= 0) AS shown FROM once WHERE camera_id IS NOT NULL GROUP BY ALL)
SELECT 'hazard' AS module, count(*) AS frames, 0 AS errors, sum(c)::BIGINT AS candidates FROM f
UNION ALL SELECT 'strict', count(*), count(*) FILTER (WHERE bad), 0 FROM f
UNION ALL SELECT 'crowd', count(*), count(*) FILTER (WHERE shown > 2), 0 FROM f WHERE frame_index IS NULL OR frame_index % 3 = 0"""
)


def queries() -> dict:
    return {
        "trial_overall": trial_overall,
        "preflight_overall": preflight_overall,
        "split_boxes": split_boxes,
        "clips_of_split": clips_of_split,
        "rolling_fps": rolling_fps,
        "degradation_samples": degradation_samples,
        "compare_lines": compare_lines,
        "person_tags": person_tags,
        "first_repeats": first_repeats,
        "first_frames": first_frames,
        "dataset_union": dataset_union,
        "hazard_messages": hazard_messages,
        "clip_starts": clip_starts,
        "report_times": report_times,
        "label_sessions": label_sessions,
        "module_errors": module_errors,
    }


def oracle_sql() -> dict:
    split = "lower(trim(split))"
    return {
        "trial_overall": f"WITH t AS ({_TRIALS_SQL}), k AS (SELECT DISTINCT camera_id, status FROM t) SELECT count(*) AS keys, count(*) FILTER (WHERE status = 'PASS') AS passed, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS overall FROM k",
        "preflight_overall": f"WITH p AS ({_PREFLIGHT_SQL}) SELECT count(*) AS checks, count(*) FILTER (WHERE status = 'WARN') AS warnings, count(*) FILTER (WHERE status = 'FAIL') AS failures, bool_or(status = 'FAIL') AS any_fail FROM p",
        "split_boxes": _SPLIT_SQL
        + """, b AS (SELECT *, CASE WHEN flag THEN id % 4 + 1 ELSE 0 END AS boxes, split_part(grp, '/', 1) AS origin FROM s)
SELECT side, count(*) AS images, count(*) FILTER (WHERE flag) AS positives, count(*) FILTER (WHERE NOT flag) AS negatives, sum(boxes)::BIGINT AS boxes, count(DISTINCT grp) AS groups, count(*) FILTER (WHERE origin = 'mail') AS mail, count(*) FILTER (WHERE origin = 'wiki') AS wiki, count(*) FILTER (WHERE origin = 'shiftlog') AS shiftlog FROM b GROUP BY side""",
        "clips_of_split": f"SELECT 'tune' AS selector, clip_id FROM clips WHERE {split} = 'tune' UNION ALL SELECT 'test', clip_id FROM clips WHERE {split} = 'test' UNION ALL SELECT 'all', clip_id FROM clips",
        "rolling_fps": f"WITH {_RUNS}, {_FPS} SELECT run_id, detector, pos, fps FROM f",
        "degradation_samples": _SAMPLES_SQL,
        "compare_lines": _COMPARE_SQL,
        "person_tags": _TAGS_SQL,
        "first_repeats": "WITH r AS (SELECT path FROM clips WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1), k AS (SELECT path, row_number() OVER (ORDER BY path) AS rn, count(*) OVER () AS n FROM r) SELECT path AS line FROM k WHERE rn <= 5 UNION ALL SELECT DISTINCT '... ' || (n - 5) || ' more' FROM k WHERE n > 5",
        "first_frames": f"WITH {_ONCE}, f AS (SELECT DISTINCT camera_id, frame_index FROM once WHERE camera_id IS NOT NULL AND frame_index IS NOT NULL) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY frame_index) <= 20",
        "dataset_union": "SELECT 'clips' AS origin, path, split, frames, NULL::INT AS width, NULL::INT AS height FROM clips UNION ALL SELECT 'cameras', camera_id, NULL, NULL, width, height FROM cameras",
        "hazard_messages": _HAZARD_SQL,
        "clip_starts": f"SELECT DISTINCT clip_id, epoch('{DAY}'::DATE)::DOUBLE + (clip_id % 24) * 3600 + (clip_id % 60) * 60 AS start FROM clips",
        "report_times": f"SELECT log_seq, {', '.join(map(_moment_sql, ('started_at', 'confirmed_at', 'closed_at')))} FROM event_log",
        "label_sessions": _SESSIONS_SQL,
        "module_errors": _MODULES_SQL,
    }
