"""Queries on detections: rules per frame, geometry, suppression, zones and poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions import pose as P
from sightline.operators.nms import suppress
from sightline.operators.policies import LabelRule, climbing, drop_overlapped, every_nth, label_match, out_of_area, zone_hits, zone_tags
from sightline.sources.tables import once, table

RULES = [
    LabelRule("hazard_object", ("knife", "scissors"), 0.4),
    LabelRule("smoking", ("cigarette", "smoking"), 0.5),
    LabelRule("smoke", ("smoke",), 0.25),
]

ZONE_COLUMNS = "zone string, polygon array<struct<x:double,y:double>>, active array<struct<start_min:int,end_min:int>>, child_filter boolean, child_ratio double, calibration struct<near_foot_y:double,near_height:double,far_foot_y:double,far_height:double>"
#: Zones of every camera in these queries: a concave one for all, one at night for children, one that isn't calibrated.
ZONES = [
    ("main_gate", [(0.1, 0.2), (0.9, 0.2), (0.9, 0.95), (0.6, 0.95), (0.6, 0.5), (0.1, 0.5)], [], False, None, None),
    ("play_yard", [(0.05, 0.4), (0.95, 0.4), (0.95, 0.99), (0.05, 0.99)], [(1320, 360)], True, 0.8, (0.9, 0.6, 0.5, 0.3)),
    ("stairs", [(0.3, 0.3), (0.7, 0.3), (0.5, 0.95)], [(480, 1080)], True, None, None),
]

_ONCE = "once AS (SELECT * EXCLUDE (ingested_at) FROM detections QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY ingested_at) = 1)"


def detections(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Each detection once, with the given columns."""
    return once(spark, sf_dir, "detections", ["det_id"], "ingested_at", *columns)


def zone_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones of all cameras: a configuration of fixed size."""
    zones = spark.createDataFrame(ZONES, ZONE_COLUMNS)
    return table(spark, sf_dir, "cameras").select("camera_id").distinct().crossJoin(zones)


def det_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts", "detector", "det_idx", "label", "confidence").where("camera_id IS NOT NULL")
    return label_match(d, RULES)


_MATCH_SQL = (
    "WITH "
    + _ONCE
    + """,
rules(label_key, event_type, mc) AS (VALUES ('knife', 'hazard_object', 0.4::DOUBLE), ('scissors', 'hazard_object', 0.4), ('cigarette', 'smoking', 0.5), ('smoking', 'smoking', 0.5), ('smoke', 'smoke', 0.25)),
hits AS (SELECT o.*, r.event_type FROM once o JOIN rules r ON lower(o.label) = r.label_key WHERE confidence >= mc AND camera_id IS NOT NULL)
SELECT camera_id, frame_index, detector, event_type, confidence, det_id, label, ts, n AS match_count FROM (
  SELECT *, count(*) OVER (PARTITION BY camera_id, frame_index, detector, event_type) AS n,
         row_number() OVER (PARTITION BY camera_id, frame_index, detector, event_type ORDER BY confidence DESC, det_idx, det_id DESC) AS rn FROM hits)
WHERE rn = 1
"""
)


def frame_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_nth(detections(spark, sf_dir, "camera_id", "frame_index", "label"), 3)


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "bbox", "frame_width", "frame_height")
    b, i, m = F.col("bbox"), G.int_box(F.col("bbox")), G.mirror(F.col("bbox"), F.col("frame_width").cast("double"))
    fx, fy = G.foot(b, F.col("frame_width"), F.col("frame_height"))
    return d.select(
        "det_id", G.width(b).alias("w"), G.height(b).alias("h"), G.area(b).alias("area"), ((i["x2"] - i["x1"]) * (i["y2"] - i["y1"])).alias("int_area"), m["x1"].alias("mirrored_x1"), m["x2"].alias("mirrored_x2"),
        fx.alias("foot_x"), fy.alias("foot_y"), G.cut_below(b, F.col("frame_height")).alias("feet_cut"), G.cut_above(b, F.col("frame_height")).alias("head_cut"),
    )


_BOX_SQL = (
    "WITH "
    + _ONCE
    + """ SELECT det_id, bbox.x2 - bbox.x1 AS w, bbox.y2 - bbox.y1 AS h,
  CASE WHEN bbox IS NOT NULL THEN greatest(0.0, bbox.x2 - bbox.x1) * greatest(0.0, bbox.y2 - bbox.y1) END AS area,
  (trunc(bbox.x2)::INT - trunc(bbox.x1)::INT) * (trunc(bbox.y2)::INT - trunc(bbox.y1)::INT) AS int_area,
  frame_width - bbox.x2 AS mirrored_x1, frame_width - bbox.x1 AS mirrored_x2,
  (bbox.x1 + bbox.x2) / 2.0 / frame_width AS foot_x, bbox.y2 / frame_height AS foot_y,
  bbox.y2 >= 0.99::DOUBLE * frame_height AS feet_cut, bbox.y1 <= 0.01::DOUBLE * frame_height AS head_cut
FROM once"""
)


def pair_iou_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of boxes of one frame, which a frame bounds: overlap, gap and closeness."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "bbox").where("bbox IS NOT NULL")
    a = d.select("camera_id", "frame_index", F.col("det_id").alias("a_id"), F.col("bbox").alias("a"))
    b = d.select("camera_id", "frame_index", F.col("det_id").alias("b_id"), F.col("bbox").alias("b"))
    x, y = F.col("a"), F.col("b")
    return a.join(b, ["camera_id", "frame_index"]).where("a_id < b_id").select("a_id", "b_id", G.iou(x, y).alias("iou"), G.gap(x, y).alias("gap"), G.overlaps(x, y).alias("overlaps"), G.near(x["x1"], x["y1"], y, 0.05).alias("corner_near"))


_PAIR_SQL = (
    "WITH "
    + _ONCE
    + """, p AS (SELECT a.det_id AS a_id, b.det_id AS b_id, a.bbox AS a, b.bbox AS b FROM once a JOIN once b USING (camera_id, frame_index)
  WHERE a.bbox IS NOT NULL AND b.bbox IS NOT NULL AND a.det_id < b.det_id),
q AS (SELECT *, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  greatest(0.0, a.x2 - a.x1) * greatest(0.0, a.y2 - a.y1) AS aa, greatest(0.0, b.x2 - b.x1) * greatest(0.0, b.y2 - b.y1) AS ba,
  greatest(0.0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) AS dx, greatest(0.0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) AS dy FROM p)
SELECT a_id, b_id, CASE WHEN aa + ba - i > 0 THEN i / (aa + ba - i) ELSE 0.0 END AS iou, sqrt(dx * dx + dy * dy) AS gap,
  a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 AS overlaps,
  a.x1 BETWEEN b.x1 - (b.x2 - b.x1) * 0.05::DOUBLE AND b.x2 + (b.x2 - b.x1) * 0.05::DOUBLE
  AND a.y1 BETWEEN b.y1 - (b.y2 - b.y1) * 0.05::DOUBLE AND b.y2 + (b.y2 - b.y1) * 0.05::DOUBLE AS corner_near
FROM q"""
)


def nms_classwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "camera_id", "frame_index", "label", "confidence", "bbox")
    return suppress(d, ["camera_id", "frame_index"], F.lower("label"), "det_id", "confidence", "bbox", 0.3).select("det_id", "label_key")


_NMS_SQL = (
    "WITH RECURSIVE "
    + _ONCE
    + """, r AS (SELECT det_id, camera_id, frame_index, lower(label) AS k, bbox, row_number() OVER (PARTITION BY camera_id, frame_index, lower(label) ORDER BY confidence DESC, det_id) AS rn
  FROM once WHERE label IS NOT NULL AND confidence IS NOT NULL AND bbox IS NOT NULL),
walk AS (
  SELECT camera_id, frame_index, k, rn, [{'id': det_id, 'b': bbox}] AS kept FROM r WHERE rn = 1
  UNION ALL
  SELECT r.camera_id, r.frame_index, r.k, r.rn,
    CASE WHEN len(list_filter(w.kept, lambda x: CASE WHEN u(x.b, r.bbox) > 0 THEN i(x.b, r.bbox) / u(x.b, r.bbox) ELSE 0.0 END > 0.3)) > 0 THEN w.kept ELSE list_append(w.kept, {'id': r.det_id, 'b': r.bbox}) END
  FROM walk w JOIN r ON r.camera_id IS NOT DISTINCT FROM w.camera_id AND r.frame_index = w.frame_index AND r.k = w.k AND r.rn = w.rn + 1)
SELECT unnest(kept).id AS det_id, k AS label_key FROM (SELECT k, arg_max(kept, rn) AS kept FROM walk GROUP BY camera_id, frame_index, k)"""
)


def _inline_boxes(sql: str) -> str:
    inter = "(greatest(0.0, least(x.b.x2, r.bbox.x2) - greatest(x.b.x1, r.bbox.x1)) * greatest(0.0, least(x.b.y2, r.bbox.y2) - greatest(x.b.y1, r.bbox.y1)))"
    area = "(greatest(0.0, {0}.x2 - {0}.x1) * greatest(0.0, {0}.y2 - {0}.y1))"
    union = f"({area.format('x.b')} + {area.format('r.bbox')} - {inter})"
    return sql.replace("u(x.b, r.bbox)", union).replace("i(x.b, r.bbox)", inter)


def overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "camera_id", "frame_index", "module_order", "label", "bbox")
    return drop_overlapped(d, ["cigarette", "person"], ["scissors", "knife", "person"]).select("det_id", "label")


_ANTI_SQL = (
    "WITH "
    + _ONCE
    + """ SELECT det_id, label FROM once d WHERE NOT EXISTS (SELECT 1 FROM once o WHERE o.camera_id = d.camera_id AND o.frame_index = d.frame_index
  AND lower(o.label) IN ('scissors', 'knife', 'person') AND lower(d.label) IN ('cigarette', 'person') AND o.module_order < d.module_order
  AND d.bbox.x1 < o.bbox.x2 AND o.bbox.x1 < d.bbox.x2 AND d.bbox.y1 < o.bbox.y2 AND o.bbox.y1 < d.bbox.y2)"""
)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir, "camera_id", "frame_index", "ts", "detector", "det_idx", "label", "confidence", "bbox", "frame_width", "frame_height")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_hits(_placed(spark, sf_dir), zone_table(spark, sf_dir))


def zone_tags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_tags(_placed(spark, sf_dir), zone_table(spark, sf_dir)).select("det_id", "zone", "tag")


def zone_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("det_id", "zone", "foot_x", "foot_y", "height_ratio")


def out_of_area_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out_of_area(_hits(spark, sf_dir))


def _sql_zones() -> str:
    def row(z) -> str:  # noqa: ANN001
        name, polygon, active, child, ratio, c = z
        p = "[" + ", ".join(f"{{'x': {x}::DOUBLE, 'y': {y}::DOUBLE}}" for x, y in polygon) + "]"
        a = ("[" + ", ".join(f"{{'s': {s}, 'e': {e}}}" for s, e in active) + "]") if active else "[]::STRUCT(s INT, e INT)[]"
        k = f"{{'nf': {c[0]}::DOUBLE, 'nh': {c[1]}::DOUBLE, 'ff': {c[2]}::DOUBLE, 'fh': {c[3]}::DOUBLE}}" if c else "NULL"
        return f"SELECT '{name}' AS zone, {p} AS polygon, {a} AS active, {str(child).lower()} AS child, {'NULL' if ratio is None else ratio}::DOUBLE AS ratio, {k}::STRUCT(nf DOUBLE, nh DOUBLE, ff DOUBLE, fh DOUBLE) AS c"

    return " UNION ALL ".join(map(row, ZONES))


_HITS_SQL = (
    "WITH "
    + _ONCE
    + f""", zones AS ({_sql_zones()}),
people AS (SELECT *, (bbox.x1 + bbox.x2) / 2.0 / frame_width AS foot_x, bbox.y2 / frame_height AS foot_y, floor((ts - floor(ts / 86400) * 86400) / 60) AS minute
  FROM once WHERE lower(label) = 'person' AND confidence >= 0.4::DOUBLE AND frame_width > 0 AND frame_height > 0 AND bbox IS NOT NULL AND NOT bbox.y2 >= 0.99::DOUBLE * frame_height),
inside AS (
  SELECT det_id, zone FROM (
    SELECT p.det_id, z.zone, p.foot_x AS x, p.foot_y AS y, unnest(range(1, len(z.polygon) + 1)) AS i, z.polygon AS g
    FROM people p JOIN (SELECT DISTINCT camera_id FROM cameras) USING (camera_id) CROSS JOIN zones z
    WHERE len(z.active) = 0 OR len(list_filter(z.active, lambda r: CASE WHEN r.s <= r.e THEN p.minute >= r.s AND p.minute < r.e ELSE p.minute >= r.s OR p.minute < r.e END)) > 0)
  GROUP BY det_id, zone
  HAVING count(*) FILTER (WHERE (g[i].y > y) <> (g[CASE i WHEN 1 THEN len(g) ELSE i - 1 END].y > y)
    AND x < (g[CASE i WHEN 1 THEN len(g) ELSE i - 1 END].x - g[i].x) * (y - g[i].y) / (g[CASE i WHEN 1 THEN len(g) ELSE i - 1 END].y - g[i].y) + g[i].x) % 2 = 1),
measured AS (
  SELECT p.*, z.zone, z.child, z.ratio, CASE WHEN z.child AND z.c IS NOT NULL AND NOT bbox.y1 <= 0.01::DOUBLE * frame_height THEN
    (bbox.y2 - bbox.y1) / frame_height / greatest(0.02::DOUBLE, c.fh + (c.nh - c.fh) / (c.nf - c.ff) * (least(greatest(foot_y, least(c.nf, c.ff) - (greatest(c.nf, c.ff) - least(c.nf, c.ff)) * 0.5), greatest(c.nf, c.ff) + (greatest(c.nf, c.ff) - least(c.nf, c.ff)) * 0.5) - c.ff)) END AS height_ratio
  FROM people p JOIN inside USING (det_id) JOIN zones z USING (zone)),
hits AS (SELECT * FROM measured WHERE NOT child OR height_ratio < coalesce(ratio, 0.75::DOUBLE))
"""
)
_AREA_SQL = (
    _HITS_SQL
    + """SELECT camera_id, frame_index, detector, zone, confidence, det_id, height_ratio, ts, n AS people_in_zone FROM (
  SELECT *, count(*) OVER (PARTITION BY camera_id, frame_index, detector, zone) AS n, row_number() OVER (PARTITION BY camera_id, frame_index, detector, zone ORDER BY confidence DESC, det_idx, det_id DESC) AS rn FROM hits)
WHERE rn = 1"""
)


def pose_class_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "keypoints").where("keypoints IS NOT NULL")
    k = F.col("keypoints")
    return d.select("det_id", P.pose_class(k).alias("pose"), P.lying(k).alias("lying"))


def climbing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts", "detector", "det_idx", "confidence", "keypoints").where("confidence IS NOT NULL")
    return climbing(d, require_both=False)


def legacy_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "keypoints", "bbox", "frame_height").where("bbox IS NOT NULL")
    k, b, h = F.col("keypoints"), F.col("bbox"), F.col("frame_height")
    return d.select("det_id", P.early_pose_class(k).alias("early_pose"), P.high_in_frame(b, k, h).alias("high_by_box"), P.high_by_points(b, k, h).alias("high_by_points"))


def _sure(i: int, axis: str) -> str:
    return f"CASE WHEN k[{i + 1}].confidence > 0.3::DOUBLE THEN k[{i + 1}].{axis} END"


def _mid(a: int, b: int, axis: str) -> str:
    p, q = _sure(a, axis), _sure(b, axis)
    return f"CASE WHEN ({p}) IS NOT NULL AND ({q}) IS NOT NULL THEN (({p}) + ({q})) / 2.0 ELSE coalesce({p}, {q}) END"


_POSE_PARTS = f"""parts AS (
  SELECT *, coalesce(abs(({_mid(5, 6, "x")}) - ({_mid(11, 12, "x")})) > abs(({_mid(5, 6, "y")}) - ({_mid(11, 12, "y")})), false) AS lying,
    coalesce(({_sure(9, "y")}) < ({_sure(0, "y")}), false) OR coalesce(({_sure(10, "y")}) < ({_sure(0, "y")}), false) AS hands,
    coalesce(({_sure(15, "y")}) < ({_mid(11, 12, "y")}), false) OR coalesce(({_sure(16, "y")}) < ({_mid(11, 12, "y")}), false) AS feet
  FROM (SELECT *, keypoints AS k FROM once) WHERE k IS NOT NULL),
posed AS (SELECT *, CASE WHEN len(k) < 17 THEN 'NORMAL' WHEN lying THEN 'LYING' WHEN hands AND feet THEN 'DANGER' WHEN hands OR feet THEN 'WARNING' ELSE 'SAFE' END AS pose FROM parts)
"""
_POSE_SQL = "WITH " + _ONCE + ", " + _POSE_PARTS + "SELECT det_id, pose, lying FROM posed"
_CLIMB_SQL = (
    "WITH "
    + _ONCE
    + ", "
    + _POSE_PARTS
    + """SELECT camera_id, frame_index, detector, confidence, det_id, pose, ts, n AS people_at_risk FROM (
  SELECT *, count(*) OVER (PARTITION BY camera_id, frame_index, detector) AS n, row_number() OVER (PARTITION BY camera_id, frame_index, detector ORDER BY confidence DESC, det_idx, det_id DESC) AS rn
  FROM posed WHERE pose IN ('DANGER', 'WARNING') AND confidence IS NOT NULL) WHERE rn = 1"""
)
_LEGACY_SQL = (
    "WITH "
    + _ONCE
    + """, b AS (SELECT *, keypoints AS k FROM once WHERE bbox IS NOT NULL),
c AS (SELECT *, coalesce(k[1].y > 0 AND k[1].confidence > 0.3::DOUBLE AND ((k[10].y < k[1].y AND k[10].confidence > 0.3::DOUBLE) OR (k[11].y < k[1].y AND k[11].confidence > 0.3::DOUBLE)), false) AS hands,
  coalesce((k[16].y < (k[12].y + k[13].y) / 2.0 AND k[16].confidence > 0.3::DOUBLE) OR (k[17].y < (k[12].y + k[13].y) / 2.0 AND k[17].confidence > 0.3::DOUBLE), false) AS feet,
  list_min(list_transform(k, lambda p: p.y)) AS top, list_sum(list_transform(k, lambda p: p.y)) / len(k) AS mean FROM b)
SELECT det_id, CASE WHEN k IS NULL OR len(k) < 17 THEN 'NORMAL' WHEN hands AND feet THEN 'DANGER' WHEN hands OR feet THEN 'WARNING' ELSE 'SAFE' END AS early_pose,
  coalesce(bbox.y1 < frame_height * 0.6::DOUBLE, false) OR coalesce(top < frame_height * 0.65::DOUBLE, false) AS high_by_box,
  coalesce(CASE WHEN k IS NOT NULL AND len(k) > 0 THEN top < frame_height * 0.68::DOUBLE OR mean < frame_height * 0.7::DOUBLE ELSE bbox.y1 < frame_height * 0.6::DOUBLE END, false) AS high_by_points
FROM c"""
)


def queries() -> dict:
    return {
        "det_label_match": det_label_match,
        "frame_skip": frame_skip,
        "box_geometry": box_geometry,
        "pair_iou_gap": pair_iou_gap,
        "nms_classwise": nms_classwise,
        "overlap_anti": overlap_anti,
        "zone_hits": zone_hits_query,
        "zone_tags": zone_tags_query,
        "out_of_area": out_of_area_query,
        "pose_class": pose_class_query,
        "climbing": climbing_query,
        "legacy_climb": legacy_climb,
    }


def oracle_sql() -> dict:
    return {
        "det_label_match": _MATCH_SQL,
        "frame_skip": "WITH " + _ONCE + " SELECT det_id, camera_id, frame_index, label FROM once WHERE frame_index % 3 = 0",
        "box_geometry": _BOX_SQL,
        "pair_iou_gap": _PAIR_SQL,
        "nms_classwise": _inline_boxes(_NMS_SQL),
        "overlap_anti": _ANTI_SQL,
        "zone_tags": _HITS_SQL
        + "SELECT det_id, zone, CASE WHEN height_ratio < coalesce(ratio, 0.75::DOUBLE) THEN 'CHILD ' ELSE 'adult ' END || (floor(height_ratio * 100 + 0.5::DOUBLE)::BIGINT // 100) || '.' || lpad((floor(height_ratio * 100 + 0.5::DOUBLE)::BIGINT % 100)::VARCHAR, 2, '0') AS tag FROM measured WHERE child AND height_ratio IS NOT NULL",
        "zone_hits": _HITS_SQL + "SELECT det_id, zone, foot_x, foot_y, height_ratio FROM hits",
        "out_of_area": _AREA_SQL,
        "pose_class": _POSE_SQL,
        "climbing": _CLIMB_SQL,
        "legacy_climb": _LEGACY_SQL,
    }
