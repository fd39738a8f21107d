"""Queries per frame and camera: boxes, summaries, flags, tags, alert slots and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions.pose import pose_class
from sightline.functions.text import mask, to_ms
from sightline.operators.lifecycle import cooldown_slots
from sightline.plans.detections import _ONCE, RULES, detections
from sightline.operators.policies import rule_table
from sightline.sources.tables import table

#: Labels that may raise an alert; a person alone never does.
HAZARDS = ("knife", "scissors")
SLOT_MS = 30_000


def frame_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest and the largest box of each frame (ties: the first)."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "bbox").where("bbox IS NOT NULL AND camera_id IS NOT NULL")
    sized = d.select("camera_id", "frame_index", "det_id", G.area(F.col("bbox")).alias("area"))
    one = sized.groupBy("camera_id", "frame_index").agg(F.min(F.struct("area", "det_id")).alias("s"), F.min(F.struct((-F.col("area")).alias("o"), "det_id", "area")).alias("l"))
    return one.select("camera_id", "frame_index", F.col("s.det_id").alias("smallest_id"), F.col("s.area").alias("smallest"), F.col("l.det_id").alias("largest_id"), F.col("l.area").alias("largest"))


_BOXES_SQL = (
    "WITH "
    + _ONCE
    + """, a AS (SELECT camera_id, frame_index, det_id, greatest(0.0, bbox.x2 - bbox.x1) * greatest(0.0, bbox.y2 - bbox.y1) AS area FROM once WHERE bbox IS NOT NULL AND camera_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY camera_id, frame_index ORDER BY area, det_id) AS s, row_number() OVER (PARTITION BY camera_id, frame_index ORDER BY area DESC, det_id) AS l FROM a)
SELECT camera_id, frame_index, max(det_id) FILTER (WHERE s = 1) AS smallest_id, max(area) FILTER (WHERE s = 1) AS smallest, max(det_id) FILTER (WHERE l = 1) AS largest_id, max(area) FILTER (WHERE l = 1) AS largest FROM r GROUP BY camera_id, frame_index"""
)


def frame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a detector says of a frame in one line: how many, and the surest with its confidence in thousandths."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "detector", "label", "confidence", "det_idx").where("camera_id IS NOT NULL AND confidence IS NOT NULL AND label IS NOT NULL")
    one = d.groupBy("camera_id", "frame_index", "detector").agg(F.count("*").alias("n"), F.max(F.struct("confidence", (-F.col("det_idx")).alias("o"), "det_id", "label")).alias("r"))
    line = F.concat(F.col("detector"), F.lit(": "), F.col("n").cast("string"), F.lit(" found, best "), F.col("r.label"), F.lit(" "), F.floor(F.col("r.confidence") * 1000 + F.lit(0.5)).cast("string"))
    return one.select("camera_id", "frame_index", "detector", line.alias("line"))


_LINES_SQL = (
    "WITH "
    + _ONCE
    + """, r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY camera_id, frame_index, detector ORDER BY confidence DESC, det_idx, det_id DESC) AS rn FROM once WHERE camera_id IS NOT NULL AND confidence IS NOT NULL AND label IS NOT NULL WINDOW w AS (PARTITION BY camera_id, frame_index, detector))
SELECT camera_id, frame_index, detector, detector || ': ' || n || ' found, best ' || label || ' ' || floor(confidence * 1000 + 0.5::DOUBLE)::BIGINT AS line FROM r WHERE rn = 1"""
)


def resolution_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per camera and size the frames that came in it, and whether it is the size and shape the camera should have."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "frame_width", "frame_height").where("camera_id IS NOT NULL")
    frames = d.groupBy("camera_id", "frame_width", "frame_height").agg(F.count_distinct("frame_index").alias("frames"))
    c = table(spark, sf_dir, "cameras").select("camera_id", "width", "height")
    same = (F.col("frame_width") == F.col("width")) & (F.col("frame_height") == F.col("height"))
    shape = F.col("frame_width").cast("long") * F.col("height") == F.col("frame_height").cast("long") * F.col("width")
    return frames.join(c, "camera_id").select("camera_id", "frame_width", "frame_height", "frames", same.alias("as_asked"), shape.alias("same_shape"), (F.col("width") / F.when(F.col("frame_width") > 0, F.col("frame_width"))).alias("scale"))


_FLAGS_SQL = (
    "WITH "
    + _ONCE
    + """, f AS (SELECT camera_id, frame_width, frame_height, count(DISTINCT frame_index) AS frames FROM once WHERE camera_id IS NOT NULL GROUP BY ALL)
SELECT camera_id, frame_width, frame_height, frames, frame_width = width AND frame_height = height AS as_asked, frame_width::BIGINT * height = frame_height::BIGINT * width AS same_shape, width / nullif(frame_width, 0) AS scale FROM f JOIN cameras USING (camera_id)"""
)


def detection_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of detections as a map: the pose where there are keypoints, and the place in the frame."""
    d = detections(spark, sf_dir, "keypoints", "bbox", "frame_width").where("bbox IS NOT NULL")
    pose = F.when(F.size("keypoints") > 0, F.create_map(F.lit("pose"), pose_class(F.col("keypoints")))).otherwise(F.create_map().cast("map<string,string>"))
    side = F.when((F.col("bbox.x1") + F.col("bbox.x2")) < F.col("frame_width"), "left").otherwise("right")
    tags = F.map_concat(pose, F.create_map(F.lit("side"), side))
    return d.select("det_id", F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("tags"))


def frame_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that may raise an alert for their camera: a hazard is in them, and the camera's slot is free."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts", "label").where("camera_id IS NOT NULL AND ts IS NOT NULL")
    hazard = d.where(F.lower("label").isin(list(HAZARDS))).groupBy("camera_id", "frame_index").agg(F.min(to_ms(F.col("ts"))).alias("t_ms"))
    return cooldown_slots(hazard, ["camera_id"], "t_ms", "frame_index", SLOT_MS)


_ALERTS_SQL = (
    "WITH RECURSIVE "
    + _ONCE
    + f""", h AS (SELECT camera_id, frame_index, min(round(ts * 1000)::BIGINT) AS t_ms FROM once WHERE camera_id IS NOT NULL AND ts IS NOT NULL AND lower(label) IN ('knife', 'scissors') GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY t_ms, frame_index) AS rn FROM h),
w AS (SELECT camera_id, rn, t_ms, frame_index, true AS free, t_ms AS last FROM c WHERE rn = 1
  UNION ALL SELECT c.camera_id, c.rn, c.t_ms, c.frame_index, c.t_ms - w.last >= {SLOT_MS}, CASE WHEN c.t_ms - w.last >= {SLOT_MS} THEN c.t_ms ELSE w.last END FROM w JOIN c ON c.camera_id = w.camera_id AND c.rn = w.rn + 1)
SELECT camera_id, t_ms, frame_index FROM w WHERE free"""
)


def frames_fired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame of a camera, and whether any rule fires on it."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "label", "confidence").where("camera_id IS NOT NULL")
    rules = F.broadcast(rule_table(d, RULES).groupBy("label_key").agg(F.min("min_confidence").alias("least")))  # the configured labels
    hit = d.join(rules, F.lower("label") == F.col("label_key"), "left")
    return hit.groupBy("camera_id", "frame_index").agg(F.coalesce(F.bool_or(F.col("confidence") >= F.col("least")), F.lit(False)).alias("fired"))


_FIRED_SQL = (
    "WITH "
    + _ONCE
    + """, r(k, m) AS (VALUES ('knife', 0.4::DOUBLE), ('scissors', 0.4), ('cigarette', 0.5), ('smoking', 0.5), ('smoke', 0.25))
SELECT camera_id, frame_index, coalesce(bool_or(confidence >= m), false) AS fired FROM once LEFT JOIN r ON lower(label) = k WHERE camera_id IS NOT NULL GROUP BY camera_id, frame_index"""
)


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per camera: frames, those on which a rule fires, and the camera's name with all but its ends masked."""
    per = frames_fired(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("frames"), F.count_if("fired").alias("fired"))
    c = table(spark, sf_dir, "cameras").select("camera_id", mask(F.col("name")).alias("masked"))
    return per.join(c, "camera_id", "left")


_DASH_SQL = f"""WITH f AS ({_FIRED_SQL}), p AS (SELECT camera_id, count(*) AS frames, count(*) FILTER (WHERE fired) AS fired FROM f GROUP BY camera_id)
SELECT camera_id, frames, fired, CASE WHEN length(name) <= 8 THEN repeat('*', length(name)) ELSE substr(name, 1, 4) || repeat('*', length(name) - 8) || right(name, 4) END AS masked FROM p LEFT JOIN cameras USING (camera_id)"""


def queries() -> dict:
    return {
        "frame_boxes": frame_boxes,
        "frame_lines": frame_lines,
        "resolution_flags": resolution_flags,
        "detection_tags": detection_tags,
        "frame_alerts": frame_alerts,
        "frames_fired": frames_fired,
        "dashboard": dashboard,
    }


def oracle_sql() -> dict:
    from sightline.plans.detections import _POSE_PARTS

    tags = "list_sort(list_concat(CASE WHEN len(d.keypoints) > 0 THEN ['pose=' || p.pose] ELSE [] END, ['side=' || CASE WHEN d.bbox.x1 + d.bbox.x2 < d.frame_width THEN 'left' ELSE 'right' END]))"
    return {
        "frame_boxes": _BOXES_SQL,
        "frame_lines": _LINES_SQL,
        "resolution_flags": _FLAGS_SQL,
        "detection_tags": "WITH " + _ONCE + ", " + _POSE_PARTS + f"SELECT d.det_id, {tags} AS tags FROM once d LEFT JOIN posed p USING (det_id) WHERE d.bbox IS NOT NULL",
        "frame_alerts": _ALERTS_SQL,
        "frames_fired": _FIRED_SQL,
        "dashboard": _DASH_SQL,
    }
