"""Queries on dataset preparation, set operations, tracking and checks of the set-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import to_ms
from sightline.operators.dataset import class_of, grouped_split, groups_under_cap, keep_class, near_any, nearest, negative_group, relocate, seeded_split, sign_hash, source_group, split_key, split_report
from sightline.operators.evaluate import base_name
from sightline.operators.tracking import fights, tracks, wrist_speeds
from sightline.plans.detections import _ONCE, detections
from sightline.sources.media import source_kind
from sightline.sources.tables import table

NEAR_BITS = 6
#: The copies: to each fifth picture one whose hash has the first (number % 9) of these bits flipped.
COPY_ID, COPY_BITS = 1_000_000_000, (3, 12, 21, 28, 34, 45, 51, 62)
_FLIPS = [sum(1 << b for b in COPY_BITS[:k]) for k in range(9)]


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as pictures: hash, group and side; and copies of them as a new export would make them, in val."""
    e = table(spark, sf_dir, "embeddings")
    own = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("g"), (F.col("vec_id") % 60).cast("string")).alias("grp"), F.when(F.col("label") < 7, "train").otherwise("val").alias("side"), sign_hash(F.col("embedding")).alias("hash"))
    flip = F.element_at(F.array(*map(F.lit, _FLIPS)).cast("array<bigint>"), (F.col("id") % 9 + 1).cast("int"))
    copies = own.where("id % 5 = 0").select((F.col("id") + COPY_ID).alias("id"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("grp"), F.lit("val").alias("side"), F.col("hash").bitwiseXOR(flip).alias("hash"))
    return own.unionByName(copies)


_HALF = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {}] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT"
_IMG = f"""own AS (SELECT vec_id AS id, 'g' || (vec_id % 60) AS grp, CASE WHEN label < 7 THEN 'train' ELSE 'val' END AS side, {_HALF.format(1)} AS lo, {_HALF.format(33)} AS hi FROM embeddings),
img AS (SELECT * FROM own UNION ALL SELECT id + {COPY_ID}, 'c' || (id % 40), 'val', xor(lo, ({[f & 0xFFFFFFFF for f in _FLIPS]})[id % 9 + 1]::BIGINT), xor(hi, ({[f >> 32 for f in _FLIPS]})[id % 9 + 1]::BIGINT) FROM own WHERE id % 5 = 0)"""
_BITS = "bit_count(xor(a.lo, b.lo))::INT + bit_count(xor(a.hi, b.hi))::INT"


def near_dup_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _images(spark, sf_dir)
    return nearest(i.where("side = 'val'").select("id", "hash"), i.where("side = 'train'").select("id", "hash"), NEAR_BITS)


def near_dup_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _images(spark, sf_dir)
    return near_any(i.where("side = 'val'"), i.where("side = 'train'"), NEAR_BITS).select("id", "grp")


def relocate_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relocate(_images(spark, sf_dir), NEAR_BITS).select("id", "grp", "side")


_RELOCATE_SQL = f"""WITH RECURSIVE {_IMG},
pairs AS (SELECT DISTINCT a.grp AS a_grp, a.side AS a_side, b.grp AS b_grp FROM img a JOIN img b ON b.side = 'val' AND a.id <> b.id AND {_BITS} <= {NEAR_BITS}),
bad AS (SELECT DISTINCT b_grp AS g FROM pairs WHERE a_side = 'train' UNION SELECT p.b_grp FROM bad JOIN pairs p ON p.a_grp = bad.g AND p.a_side = 'val')
SELECT id, grp, CASE WHEN grp IN (SELECT g FROM bad) THEN 'train' ELSE side END AS side FROM img"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: their source is the group, every seventh is flagged."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("grp"), (F.col("doc_id") % 7 == 0).alias("flag"))


def grouped_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split(_items(spark, sf_dir))


def split_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_report(grouped_split(_items(spark, sf_dir)))


def group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_under_cap(_items(spark, sf_dir), 400)


_GROUPS = """i AS (SELECT doc_id AS id, coalesce(source, 'none') AS grp, doc_id % 7 = 0 AS flag FROM documents),
g AS (SELECT grp, count(*) AS size, max(flag::INT) AS stratum, md5('0|' || grp) AS h FROM i GROUP BY grp)"""
_SPLIT_SQL = f"""WITH RECURSIVE {_GROUPS},
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, grp) AS rn, floor(sum(size) OVER (PARTITION BY stratum) * 0.15::DOUBLE + 0.5::DOUBLE) AS target FROM g),
w AS (
  SELECT stratum, rn, grp, 0 < target AND size <= target * 1.2::DOUBLE + 1 AS taken, CASE WHEN 0 < target AND size <= target * 1.2::DOUBLE + 1 THEN size ELSE 0 END AS val FROM r WHERE rn = 1
  UNION ALL
  SELECT r.stratum, r.rn, r.grp, w.val < r.target AND w.val + r.size <= r.target * 1.2::DOUBLE + 1, w.val + CASE WHEN w.val < r.target AND w.val + r.size <= r.target * 1.2::DOUBLE + 1 THEN r.size ELSE 0 END
  FROM w JOIN r ON r.stratum = w.stratum AND r.rn = w.rn + 1),
s AS (SELECT i.id, i.grp, i.flag, CASE WHEN taken THEN 'val' ELSE 'train' END AS side FROM i JOIN w USING (grp))
"""
_CAP_SQL = f"""WITH RECURSIVE {_GROUPS},
r AS (SELECT *, row_number() OVER (ORDER BY h, grp) AS rn FROM g),
w AS (SELECT rn, grp, size, size <= 400 AS taken, CASE WHEN size <= 400 THEN size ELSE 0 END AS total FROM r WHERE rn = 1
  UNION ALL SELECT r.rn, r.grp, r.size, w.total + r.size <= 400, w.total + CASE WHEN w.total + r.size <= 400 THEN r.size ELSE 0 END FROM w JOIN r ON r.rn = w.rn + 1)
SELECT grp, size FROM w WHERE taken"""


def seeded_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_split(table(spark, sf_dir, "documents").withColumn("k", F.coalesce("kind", F.lit("none"))), "k", "doc_id")


_SEEDED_SQL = """WITH d AS (SELECT coalesce(kind, 'none') AS class, doc_id AS name FROM documents)
SELECT class, name, CASE WHEN row_number() OVER (PARTITION BY class ORDER BY md5('0|' || name), name) <= floor(count(*) OVER (PARTITION BY class) * 0.15::DOUBLE + 0.5::DOUBLE) THEN 'val' ELSE 'train' END AS side FROM d"""


def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "clips").select(base_name(F.col("path")).alias("file")).distinct()
    n = n.withColumn("name", F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), r"[^/]$", "0_jpg.rf.ab"))
    return n.select("file", source_group(F.col("name")).alias("source_group"), split_key(F.col("name")).alias("split_key"), negative_group(F.concat(F.lit("neg__"), F.regexp_replace("file", "_", "__"))).alias("negative_group"), class_of(F.col("file"), "smoking_", "fight_").alias("class"))


_SOURCE_SQL = r"""WITH n AS (SELECT DISTINCT regexp_extract(path, '([^/\\]*)$', 1) AS file FROM clips),
m AS (SELECT file, regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '[^/]$', '0_jpg.rf.ab') AS name FROM n),
b AS (SELECT *, regexp_replace(name, '_(?:jpg|jpeg|png)\.rf\..*$', '', 'i') AS base FROM m),
g AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(base, '[_\-](?:jpe?g|png|webp)$', '', 'i'), '[\s_\-()0-9]+$', ''), ''), '<numeric-only>') AS source_group FROM b),
h AS (SELECT *, string_split('neg__' || replace(file, '_', '__'), '__') AS p FROM g)
SELECT file, CASE WHEN file IS NULL THEN NULL ELSE source_group END AS source_group, CASE WHEN file IS NULL THEN NULL WHEN source_group IN ('<numeric-only>', 'gambar') THEN 'id:' || base ELSE source_group END AS split_key,
  'neg:' || array_to_string(p[2:len(p) - 1], '/') AS negative_group, CASE WHEN starts_with(lower(file), 'fight_') THEN 0 WHEN starts_with(lower(file), 'smoking_') THEN 1 END AS class FROM h"""


def label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines made from boxes, and what is left of them for one class."""
    d = detections(spark, sf_dir, "module_order", "bbox").where("bbox IS NOT NULL")
    line = F.concat_ws(" ", F.col("module_order").cast("string"), *(F.col(f"bbox.{c}").cast("int").cast("string") for c in ("x1", "y1", "x2", "y2")))
    return d.select("det_id", keep_class(F.when(F.col("det_id") % 5 == 0, F.concat(line, F.lit(" 1"))).otherwise(line), 1).alias("line"))


_LINE_SQL = (
    "WITH "
    + _ONCE
    + """ SELECT det_id, CASE WHEN det_id % 5 <> 0 AND module_order = 1 THEN '0 ' || trunc(bbox.x1)::INT || ' ' || trunc(bbox.y1)::INT || ' ' || trunc(bbox.x2)::INT || ' ' || trunc(bbox.y2)::INT END AS line FROM once WHERE bbox IS NOT NULL"""
)


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that clips expect against those that fired, by every set operation."""
    c = table(spark, sf_dir, "clips")
    a = c.select(F.explode("expected").alias("t"))
    b = c.select(F.explode(F.map_keys("fired")).alias("t"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "except_all": a.exceptAll(b), "intersect_all": a.intersectAll(b)}
    parts = [d.groupBy("t").agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "t", "n") for k, d in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SET_SQL = """WITH a AS (SELECT unnest(expected) AS t FROM clips), b AS (SELECT unnest(map_keys(fired)) AS t FROM clips)
SELECT 'union' AS op, t, count(*) AS n FROM (SELECT t FROM a UNION SELECT t FROM b) GROUP BY t
UNION ALL SELECT 'intersect', t, count(*) FROM (SELECT t FROM a INTERSECT SELECT t FROM b) GROUP BY t
UNION ALL SELECT 'except', t, count(*) FROM (SELECT t FROM a EXCEPT SELECT t FROM b) GROUP BY t
UNION ALL SELECT 'except_all', t, count(*) FROM (SELECT t FROM a EXCEPT ALL SELECT t FROM b) GROUP BY t
UNION ALL SELECT 'intersect_all', t, count(*) FROM (SELECT t FROM a INTERSECT ALL SELECT t FROM b) GROUP BY t"""


def output_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two outputs (all deliveries, and each detection once) have that the other hasn't, as multisets."""
    cols = ["camera_id", "frame_index", "label", F.round("confidence", 4).alias("confidence"), F.col("bbox.x1").cast("int").alias("x1"), F.col("bbox.y2").cast("int").alias("y2")]
    a = table(spark, sf_dir, "detections").select(*cols)
    b = detections(spark, sf_dir, "camera_id", "frame_index", "label", "confidence", "bbox").select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


_EQUAL_SQL = (
    "WITH "
    + _ONCE
    + """, a AS (SELECT camera_id, frame_index, label, round(confidence, 4) AS confidence, trunc(bbox.x1)::INT AS x1, trunc(bbox.y2)::INT AS y2 FROM detections),
b AS (SELECT camera_id, frame_index, label, round(confidence, 4) AS confidence, trunc(bbox.x1)::INT AS x1, trunc(bbox.y2)::INT AS y2 FROM once)
SELECT *, 'first' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)


def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths registered more than once."""
    return table(spark, sf_dir, "clips").where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("clip_id").alias("ids")).where("n > 1")


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the cameras' set-up as rows: name, frame rate, seen at all."""
    c = table(spark, sf_dir, "cameras")
    seen = detections(spark, sf_dir, "camera_id").select("camera_id").where("camera_id IS NOT NULL").distinct()
    rows = c.join(seen.withColumn("seen", F.lit(True)), "camera_id", "left")
    checks = F.array(
        F.struct(F.lit("name").alias("check"), F.when(F.col("name").isNull(), "WARN").otherwise("OK").alias("status")),
        F.struct(F.lit("fps").alias("check"), F.when(F.coalesce(F.col("fps") > 0, F.lit(False)), "OK").otherwise("WARN").alias("status")),
        F.struct(F.lit("seen").alias("check"), F.when(F.col("seen"), "OK").otherwise("FAIL").alias("status")),
    )
    return rows.select("camera_id", F.explode(checks).alias("c")).select("camera_id", "c.check", "c.status")


_PREFLIGHT_SQL = """WITH s AS (SELECT c.*, camera_id IN (SELECT camera_id FROM detections WHERE camera_id IS NOT NULL) AS seen FROM cameras c)
SELECT camera_id, 'name' AS "check", CASE WHEN name IS NULL THEN 'WARN' ELSE 'OK' END AS status FROM s
UNION ALL SELECT camera_id, 'fps', CASE WHEN fps > 0 THEN 'OK' ELSE 'WARN' END FROM s UNION ALL SELECT camera_id, 'seen', CASE WHEN seen THEN 'OK' ELSE 'FAIL' END FROM s"""


def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clips").select("path").distinct()
    return c.select("path", source_kind(F.col("path")).alias("kind"), source_kind(F.concat(F.lit("rtsp://"), "path")).alias("as_url"))


_KINDS_SQL = """SELECT DISTINCT path, CASE WHEN path IS NULL THEN NULL WHEN regexp_full_match(path, '[0-9]+') THEN 'webcam' WHEN contains(path, '://') THEN 'stream' WHEN regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|webp|tif|tiff)$') THEN 'image' ELSE 'video' END AS kind,
  CASE WHEN path IS NULL THEN NULL ELSE 'stream' END AS as_url FROM clips"""


def video_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of each frame from its number and the camera's frame rate (30 where it is unknown or 0)."""
    rate = F.coalesce(F.when(F.col("fps") != 0, F.col("fps")), F.lit(30.0))
    cameras = F.broadcast(table(spark, sf_dir, "cameras").select("camera_id", rate.alias("rate")))  # a table of fixed size
    return detections(spark, sf_dir, "camera_id", "frame_index").join(cameras, "camera_id").select("det_id", (F.lit(1767571200.0) + F.col("frame_index") / F.col("rate")).alias("clock"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts", "det_idx", "label", "confidence", "bbox", "keypoints").where("keypoints IS NOT NULL")
    return d.withColumn("t_ms", to_ms(F.col("ts"))).drop("ts")


def staged_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two people played before each camera at ten frames a second: the wrist of one swings into the other who stands
    beside; the same with the other far off, with a still wrist, with one that stays out, and with a slow one."""
    c = table(spark, sf_dir, "cameras").select("camera_id", F.regexp_extract("camera_id", "([0-9]+)", 1).cast("int").alias("n"))
    f = c.withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("kind", F.col("n") % 5)
    swings = F.col("frame_index") % 8 < 4
    x = F.when(F.col("kind") == 2, 350).when(F.col("kind") == 3, F.when(swings, 110).otherwise(280)).when(F.col("kind") == 4, 250 + 10 * (F.col("frame_index") % 20)).otherwise(F.when(swings, 250).otherwise(450))
    f = f.withColumn("x", x.cast("double")).withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    left = F.when(F.col("p") == 0, 100.0).when(F.col("kind") == 1, 900.0).otherwise(310.0)
    wrist = F.struct(F.when(F.col("p") == 0, F.col("x")).otherwise(left + 150).alias("x"), F.lit(250.0).alias("y"), F.lit(0.9).alias("confidence"))
    other = F.struct((left + 100).alias("x"), F.lit(200.0).alias("y"), F.lit(0.1).alias("confidence"))
    keypoints = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.when(i == 9, wrist).otherwise(other))
    bbox = F.struct(left.alias("x1"), F.lit(100.0).alias("y1"), (left + 200).alias("x2"), F.lit(500.0).alias("y2"))
    return f.select(
        (F.col("n").cast("long") * 1000 + F.col("frame_index") * 2 + F.col("p")).alias("det_id"), "camera_id", F.col("frame_index").cast("long").alias("frame_index"), (F.col("frame_index") * 100).cast("long").alias("t_ms"),
        F.col("p").alias("det_idx"), F.lit("person").alias("label"), F.lit(0.9).alias("confidence"), bbox.alias("bbox"), keypoints.alias("keypoints"),
    )


def fight_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blows of the staged scenes: staged because no person in the detections strikes."""
    return fights(staged_people(spark, sf_dir)).withColumn("wrist_speed", F.round("wrist_speed", 6))


_FIGHT_SQL = """WITH f AS (SELECT camera_id, regexp_extract(camera_id, '([0-9]+)', 1)::INT AS n, unnest(range(40)) AS frame_index FROM cameras),
x AS (SELECT *, n % 5 AS kind, (CASE n % 5 WHEN 2 THEN 350 WHEN 3 THEN CASE WHEN frame_index % 8 < 4 THEN 110 ELSE 280 END WHEN 4 THEN 250 + 10 * (frame_index % 20) ELSE CASE WHEN frame_index % 8 < 4 THEN 250 ELSE 450 END END)::DOUBLE AS x FROM f),
v AS (SELECT *, lag(x, 3) OVER (PARTITION BY camera_id ORDER BY frame_index) AS old, CASE WHEN kind = 1 THEN 900 ELSE 310 END AS b FROM x),
s AS (SELECT *, abs(x - old) / 400 / (frame_index / 10.0::DOUBLE - (frame_index - 3) / 10.0::DOUBLE) AS speed FROM v)
SELECT camera_id, frame_index, frame_index * 100 AS t_ms, 0.9::DOUBLE AS confidence, n::BIGINT * 1000 + frame_index * 2 AS det_id, n::BIGINT * 1000 + frame_index * 2 + 1 AS other_det_id, round(speed, 6) AS wrist_speed, 1 AS pairs, [1, 2] AS track_ids
FROM s WHERE speed >= 1.5 AND x BETWEEN b - 10 AND b + 210 AND b - 300 <= 0.15::DOUBLE * 400"""


def fight_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blows between people of the detections."""
    return fights(_people(spark, sf_dir))


def person_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(_people(spark, sf_dir))


def wrist_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrist_speeds(_people(spark, sf_dir))


_WRIST_SQL = (
    "WITH "
    + _ONCE
    + """, p AS (SELECT det_id, camera_id, det_idx, round(ts * 1000)::BIGINT AS t_ms, keypoints[10].x AS x, keypoints[10].y AS y, greatest(1.0, bbox.y2 - bbox.y1) AS h FROM once
  WHERE lower(label) = 'person' AND confidence >= 0.4::DOUBLE AND len(keypoints) > 0 AND bbox IS NOT NULL AND camera_id IS NOT NULL AND ts IS NOT NULL AND keypoints[10].confidence > 0.3::DOUBLE),
q AS (SELECT *, max({'t': t_ms, 'd': det_id, 'x': x, 'y': y}) OVER (PARTITION BY camera_id, det_idx ORDER BY t_ms RANGE BETWEEN 1000 PRECEDING AND 250 PRECEDING) AS r FROM p)
SELECT det_id, sqrt((x - r.x) * (x - r.x) + (y - r.y) * (y - r.y)) / h / ((t_ms - r.t) / 1000.0::DOUBLE) AS speed FROM q WHERE r IS NOT NULL"""
)


def queries() -> dict:
    return {
        "near_dup_nearest": near_dup_nearest,
        "near_dup_semi": near_dup_semi,
        "relocate_dups": relocate_dups,
        "grouped_split": grouped_split_query,
        "split_report": split_report_query,
        "group_cap": group_cap,
        "seeded_split": seeded_split_query,
        "source_groups": source_groups,
        "label_parse": label_parse,
        "set_ops": set_ops,
        "output_equivalence": output_equivalence,
        "repeated_paths": repeated_paths,
        "preflight": preflight,
        "source_kinds": source_kinds,
        "video_clock": video_clock,
        "fight_candidates": fight_candidates,
        "fight_detections": fight_detections,
        "person_tracks": person_tracks,
        "wrist_speed": wrist_speed,
    }


def oracle_sql() -> dict:
    return {
        "near_dup_nearest": f"WITH {_IMG}, p AS (SELECT a.id, b.id AS near_id, {_BITS} AS bits FROM img a JOIN img b ON a.side = 'val' AND b.side = 'train') SELECT * FROM p WHERE bits <= {NEAR_BITS} QUALIFY row_number() OVER (PARTITION BY id ORDER BY bits, near_id) = 1",
        "near_dup_semi": f"WITH {_IMG} SELECT id, grp FROM img a WHERE side = 'val' AND EXISTS (SELECT 1 FROM img b WHERE b.side = 'train' AND {_BITS} <= {NEAR_BITS})",
        "relocate_dups": _RELOCATE_SQL,
        "grouped_split": _SPLIT_SQL + "SELECT * FROM s",
        "split_report": _SPLIT_SQL + "SELECT side, count(*) AS images, count(*) FILTER (WHERE flag) AS positives, count(*) FILTER (WHERE NOT flag) AS negatives, count(DISTINCT grp) AS groups FROM s GROUP BY side",
        "group_cap": _CAP_SQL,
        "seeded_split": _SEEDED_SQL,
        "source_groups": _SOURCE_SQL,
        "label_parse": _LINE_SQL,
        "set_ops": _SET_SQL,
        "output_equivalence": _EQUAL_SQL,
        "repeated_paths": "SELECT path, count(*) AS n, count(DISTINCT clip_id) AS ids FROM clips WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1",
        "preflight": _PREFLIGHT_SQL,
        "source_kinds": _KINDS_SQL,
        "video_clock": "WITH " + _ONCE + " SELECT det_id, 1767571200.0::DOUBLE + frame_index / coalesce(nullif(fps, 0), 30.0::DOUBLE) AS clock FROM once JOIN cameras USING (camera_id)",
        "wrist_speed": _WRIST_SQL,
        "fight_candidates": _FIGHT_SQL,
    }
