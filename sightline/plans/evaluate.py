"""Queries on clips, classifier scores, tests and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import to_ms
from sightline.operators.evaluate import (
    GATES,
    choose_threshold,
    clip_name,
    clip_scores,
    clip_verdict,
    frame_peaks,
    gate_status,
    median_of,
    rolling,
    tenths,
    threshold_sweep,
    timed_test,
    trial_test,
    upper_median,
)
from sightline.plans.detections import _ONCE, detections
from sightline.sources.tables import once, table

_STEM = "regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_RUNS = "runs AS (SELECT * FROM run_stats QUALIFY row_number() OVER (PARTITION BY run_id, detector ORDER BY ingested_at) = 1), vals AS (SELECT *, list_transform(list_filter(infer_ms, lambda x: x IS NOT NULL AND NOT isnan(x) AND x >= 0 AND x < 1e15), lambda x: round(x * 10)::BIGINT) AS v FROM runs)"


def clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "clips")
    return c.select("clip_id", "path", *(v.alias(k if k != "group" else "grp") for k, v in clip_name(F.col("path")).items())).distinct()


_CLIP_NAMES_SQL = f"""WITH p AS (SELECT DISTINCT clip_id, path, string_split(lower({_STEM}), '_') AS s FROM clips),
q AS (SELECT *, CASE WHEN path IS NULL OR len(s) < 4 THEN 'too few parts' WHEN s[1] NOT IN ('hazard', 'smoking', 'fight', 'climbing', 'outarea', 'normal') THEN 'unknown module'
  WHEN s[2] NOT IN ('pos', 'neg') THEN 'unknown polarity' WHEN s[1] = 'normal' AND s[2] = 'pos' THEN 'normal clips are negative' WHEN NOT regexp_full_match(s[3], 's[0-9]+') THEN 'unknown session' END AS problem FROM p)
SELECT clip_id, path, CASE WHEN problem IS NULL THEN s[1] END AS module, CASE WHEN problem IS NULL THEN s[2] END AS polarity, CASE WHEN problem IS NULL THEN s[3] END AS session,
  CASE WHEN problem IS NULL THEN CASE s[1] WHEN 'hazard' THEN 'hazard_object' WHEN 'outarea' THEN 'out_of_area' WHEN 'normal' THEN NULL ELSE s[1] END END AS event_type, s[5] AS grp, problem FROM q"""


def clip_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_scores(table(spark, sf_dir, "clips"))


_SCORES_SQL = """WITH types AS (SELECT DISTINCT t FROM (SELECT unnest(expected) AS t FROM clips UNION SELECT unnest(map_keys(fired)) FROM clips) WHERE t IS NOT NULL),
x AS (SELECT t, coalesce(list_contains(expected, t), false) AS w, coalesce(fired[t], 0) AS f, coalesce(duration_s::DECIMAL(18,3), 0) AS s FROM clips CROSS JOIN types),
y AS (SELECT t AS event_type, count(*) FILTER (WHERE w AND f > 0) AS tp, count(*) FILTER (WHERE w AND f = 0) AS fn, count(*) FILTER (WHERE NOT w AND f > 0) AS fp_clips, count(*) FILTER (WHERE NOT w) AS neg_clips,
  coalesce(sum(f) FILTER (WHERE NOT w), 0)::BIGINT AS fp_events, coalesce(sum(s) FILTER (WHERE NOT w), 0)::DOUBLE AS neg_seconds FROM x GROUP BY t)
SELECT *, CASE WHEN neg_seconds > 0 THEN fp_events / (neg_seconds / 3600.0::DOUBLE) ELSE 0.0 END AS fp_per_hour FROM y"""


def gate_status_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_status(table(spark, sf_dir, "clips").where("lower(trim(split)) = 'test'"), available=["out_of_area", "fight", "hazard_object"])


def _gates_sql() -> str:
    rows = ", ".join(f"({i}, '{g.module}', '{g.polarity}', '{g.group}', '{g.event_type}', '{g.count}', '{g.op}', {g.k}, {g.n}, '{g.label or ''}', {g.min_conf})" for i, g in enumerate(GATES))
    return f"""WITH g(gate, module, polarity, grp, event_type, cnt, op, k, n, label, mc) AS (VALUES {rows}),
c AS (SELECT string_split(lower({_STEM}), '_') AS s, fired, max_conf FROM clips WHERE lower(trim(split)) = 'test'),
j AS (SELECT g.*, c.s IS NOT NULL AS has, CASE cnt WHEN 'label' THEN coalesce(max_conf[label], 0) >= mc WHEN 'alerted' THEN coalesce(fired[event_type], 0) > 0 ELSE coalesce(fired[event_type], 0) = 0 END AS hit
  FROM g LEFT JOIN c ON s[1] = module AND s[2] = polarity AND s[5] = grp),
a AS (SELECT gate, event_type, any_value(op) AS op, any_value(k) AS k, any_value(n) AS n, count(*) FILTER (WHERE has) AS clips, count(*) FILTER (WHERE has AND hit) AS counted FROM j GROUP BY gate, event_type)
SELECT gate, event_type, clips, counted, CASE WHEN clips < n THEN 'INCOMPLETE' WHEN clips > n THEN 'CHECK' WHEN CASE op WHEN '>=' THEN counted >= k ELSE counted <= k END THEN 'PASS' ELSE 'FAIL' END AS status FROM a"""


def label_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir, "camera_id", "frame_index", "label", "confidence").where("confidence <= 1")
    return frame_peaks(d.withColumn("label", F.lower("label")), ["camera_id"])


_PEAKS_SQL = (
    "WITH "
    + _ONCE
    + """, f AS (SELECT camera_id, frame_index, lower(label) AS label, max(confidence) AS c FROM once WHERE confidence <= 1 GROUP BY ALL)
SELECT camera_id, label, max(c) AS best_conf, count(*) FILTER (WHERE c >= 0.4::DOUBLE) AS frames_over, count(*) AS frames FROM f GROUP BY ALL"""
)


def _smoke_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each camera with whether smoke is seen in them and how surely (in thousandths)."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts", "label", "confidence").where("camera_id IS NOT NULL AND ts IS NOT NULL")
    sure = F.when((F.lower("label") == "smoke") & (F.col("confidence") >= 0.25), F.round(F.col("confidence") * 1000).cast("bigint"))
    f = d.groupBy("camera_id", "frame_index").agg(F.min(to_ms(F.col("ts"))).alias("t_ms"), F.max(sure).alias("conf_milli"))
    return f.withColumn("hit", F.col("conf_milli").isNotNull())


_SMOKE_SQL = (
    _ONCE
    + """, sf AS (SELECT *, conf_milli IS NOT NULL AS hit FROM (SELECT camera_id, frame_index, min(round(ts * 1000)::BIGINT) AS t_ms, max(CASE WHEN lower(label) = 'smoke' AND confidence >= 0.25::DOUBLE THEN round(confidence * 1000)::BIGINT END) AS conf_milli
  FROM once WHERE camera_id IS NOT NULL AND ts IS NOT NULL GROUP BY camera_id, frame_index))"""
)


def smoke_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cameras as clips: those of even number should show smoke, the others not."""
    clips = _smoke_frames(spark, sf_dir).groupBy("camera_id").agg(F.count_if("hit").alias("detected_frames"))
    kind = F.when(F.regexp_extract("camera_id", "([0-9]+)$", 1).cast("int") % 2 == 0, "pos").otherwise("neg")
    return clip_verdict(clips.withColumn("kind", kind), 20, 4, 2)


_VERDICT_SQL = f"""WITH {_SMOKE_SQL},
c AS (SELECT camera_id, count(*) FILTER (WHERE hit) AS d, regexp_extract(camera_id, '([0-9]+)$', 1)::INT % 2 = 0 AS pos FROM sf GROUP BY camera_id),
v AS (SELECT count(*) FILTER (WHERE pos) AS pos_clips, count(*) FILTER (WHERE pos AND d > 0) AS pos_detected, count(*) FILTER (WHERE NOT pos) AS neg_clips, count(*) FILTER (WHERE NOT pos AND d > 2) AS neg_failed FROM c)
SELECT *, CASE WHEN pos_clips <> 20 OR neg_clips < 1 THEN 'INCOMPLETE' WHEN pos_detected >= 4 AND neg_failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM v"""


def timed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_test(_smoke_frames(spark, sf_dir), "camera_id", 86400, 3)


def timed_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_test(_smoke_frames(spark, sf_dir), "camera_id", 5, 36000, 86400, 3)


_TIMED_SQL = f"""WITH {_SMOKE_SQL},
b AS (SELECT *, min(t_ms) OVER (PARTITION BY camera_id) AS t0, max(t_ms) OVER (PARTITION BY camera_id) AS t1 FROM sf),
o AS (SELECT camera_id, count(*) AS frames, count(*) FILTER (WHERE hit) AS detected, max(t1 - t0) AS span FROM b WHERE t_ms - t0 < 86400000 GROUP BY camera_id)
SELECT camera_id, frames, detected, CASE WHEN span < 86400000 THEN 'INCOMPLETE' WHEN detected <= 3 THEN 'PASS' ELSE 'FAIL' END AS status FROM o"""
_TRIALS_SQL = f"""WITH {_SMOKE_SQL},
b AS (SELECT *, min(t_ms) OVER (PARTITION BY camera_id) AS t0, max(t_ms) OVER (PARTITION BY camera_id) AS t1 FROM sf),
k AS (SELECT *, (t_ms - t0) // 86400000 AS trial FROM b),
o AS (SELECT camera_id, trial, count(*) AS frames, count(*) FILTER (WHERE hit) AS detected, max(conf_milli) AS best_milli, sum(conf_milli)::BIGINT AS s FROM k
  WHERE trial < 5 AND t_ms - t0 - trial * 86400000 < 36000000 AND t1 - t0 >= trial * 86400000 + 36000000 GROUP BY camera_id, trial),
z AS (SELECT camera_id, CASE WHEN count(*) < 5 THEN 'INCOMPLETE' WHEN count(*) FILTER (WHERE detected > 0) >= 3 THEN 'PASS' ELSE 'FAIL' END AS status FROM o GROUP BY camera_id)
SELECT camera_id, trial, frames, detected, best_milli, detected / frames AS rate, CASE WHEN detected > 0 THEN s / detected / 1000.0::DOUBLE ELSE 0.0 END AS mean_conf, status FROM o JOIN z USING (camera_id)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as images: a label, whether the detector fires, and a classifier's probability, from their ids."""
    d = detections(spark, sf_dir, "confidence").where("confidence IS NOT NULL")
    return d.select(F.expr("CAST(det_id % 3 = 0 AS int)").alias("label"), (F.col("confidence") >= 0.5).alias("det_fired"), (((F.col("det_id") * 7919) % 1000) / F.lit(1000.0)).alias("cls_prob"))


_SWEEP_SQL = (
    "WITH "
    + _ONCE
    + """, s AS (SELECT det_id % 3 = 0 AS y, confidence >= 0.5::DOUBLE AS d, (det_id * 7919 % 1000) / 1000.0::DOUBLE AS p FROM once WHERE confidence IS NOT NULL),
t AS (SELECT i / 20 AS threshold FROM range(1, 20) r(i) UNION ALL SELECT NULL),
c AS (SELECT threshold, count(*) FILTER (WHERE y AND f) AS tp, count(*) FILTER (WHERE y AND NOT f) AS fn, count(*) FILTER (WHERE NOT y AND f) AS fp, count(*) FILTER (WHERE NOT y AND NOT f) AS tn
  FROM (SELECT threshold, y, d AND (threshold IS NULL OR p >= threshold) AS f FROM s CROSS JOIN t) GROUP BY threshold),
sweep AS (SELECT threshold, tp, fn, fp, tn, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
"""
)
_CHOICE_SQL = (
    _SWEEP_SQL
    + """, base AS (SELECT * FROM sweep WHERE threshold IS NULL),
best AS (SELECT s.* FROM sweep s, base b WHERE s.threshold IS NOT NULL AND s.recall >= b.recall - 0.5::DOUBLE - 1e-9 ORDER BY s.fp, s.threshold LIMIT 1)
SELECT best.threshold, best.tp, best.fp, base.tp AS base_tp, base.fp AS base_fp, coalesce(best.fp < base.fp, false) AS adopted FROM base LEFT JOIN best ON true"""
)


def sweep_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_sweep(_scores(spark, sf_dir))


def choice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose_threshold(threshold_sweep(_scores(spark, sf_dir)), 0.5)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("camera_id", "started_at", "frames", "seconds", "errors", "confirmed", "infer_ms")
    return once(spark, sf_dir, "run_stats", ["run_id", "detector"], "ingested_at", *columns).withColumn("v", tenths(F.col("infer_ms")))


def rolling_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median inference time over the last 30 frames of a run, at each frame."""
    r = rolling(_runs(spark, sf_dir), ["run_id", "detector"], "v")
    return r.select("run_id", "detector", "pos", (F.col("total") / F.col("n") / F.lit(10.0)).alias("mean_ms"), (F.col("median") / F.lit(10.0)).alias("median_ms"))


_ROLLING_SQL = f"""WITH {_RUNS}, e AS (SELECT run_id, detector, unnest(v) AS x, unnest(range(len(v))) AS pos FROM vals WHERE len(v) > 0)
SELECT run_id, detector, pos, sum(x) OVER w / count(*) OVER w / 10.0::DOUBLE AS mean_ms, median(x) OVER w / 10.0::DOUBLE AS median_ms FROM e WINDOW w AS (PARTITION BY run_id, detector ORDER BY pos ROWS 29 PRECEDING)"""


def median_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).where(F.size("v") > 0)
    return r.select("run_id", "detector", (median_of(F.col("v")) / F.lit(10.0)).alias("median_ms"), (upper_median(F.col("v")) / F.lit(10.0)).alias("upper_median_ms"))


def stage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector's part of all inference time, and its mean against that of the slowest."""
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x)
    per = _runs(spark, sf_dir).groupBy("detector").agg(F.sum(total).alias("t"), F.sum(F.greatest(F.size("v"), F.lit(0))).alias("n"))
    all_ = per.agg(F.sum("t").alias("all"), F.min(F.when(F.col("n") > 0, F.struct((F.col("t") / F.col("n")).alias("m"), "detector"))).alias("f"))
    return per.join(F.broadcast(all_)).select("detector", F.when(F.col("all") > 0, F.col("t") / F.col("all")).alias("share"), (F.col("t") / F.col("n") / F.lit(10.0) - F.col("f.m") / F.lit(10.0)).alias("delta_ms"), (F.col("f.detector") == F.col("detector")).alias("fastest"))


_SHARE_SQL = f"""WITH {_RUNS}, per AS (SELECT detector, sum(list_sum(v)) AS t, sum(coalesce(len(v), 0)) AS n FROM vals GROUP BY detector)
SELECT detector, t / sum(t) OVER () AS share, t / n / 10.0::DOUBLE - first_value(t / n) OVER (ORDER BY t / n, detector) / 10.0::DOUBLE AS delta_ms, detector = first_value(detector) OVER (ORDER BY t / n, detector) AS fastest FROM per"""


def run_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).groupBy("detector").agg(F.sum("frames").alias("frames"), F.sum(F.col("seconds").cast("decimal(18,3)")).cast("double").alias("seconds"), F.sum("errors").alias("errors"), F.sum("confirmed").alias("confirmed"))
    return r.withColumn("fps", F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(F.lit(0.0)))


_FPS_SQL = f"""WITH {_RUNS}, a AS (SELECT detector, sum(frames)::BIGINT AS frames, sum(seconds::DECIMAL(18,3))::DOUBLE AS seconds, sum(errors)::BIGINT AS errors, sum(confirmed)::BIGINT AS confirmed FROM runs GROUP BY detector)
SELECT *, CASE WHEN seconds > 0 THEN frames / seconds ELSE 0.0 END AS fps FROM a"""


def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a camera's detector ran below nine tenths of the speed of its first day."""
    day = F.floor(F.col("started_at") / 86400).alias("day")
    d = _runs(spark, sf_dir).where("camera_id IS NOT NULL AND started_at IS NOT NULL").groupBy("camera_id", "detector", day).agg(F.sum("frames").alias("f"), F.sum(F.col("seconds").cast("decimal(18,3)")).cast("double").alias("s"))
    d = d.where("s > 0").select("camera_id", "detector", "day", (F.col("f") / F.col("s")).alias("fps"))
    first = d.groupBy("camera_id", "detector").agg(F.min_by("fps", "day").alias("first_fps"))
    return d.join(first, ["camera_id", "detector"]).withColumn("degraded", F.col("fps") < F.col("first_fps") * 0.9)


_DEGRADED_SQL = f"""WITH {_RUNS}, a AS (SELECT camera_id, detector, floor(started_at / 86400)::BIGINT AS day, sum(frames) AS f, sum(seconds::DECIMAL(18,3))::DOUBLE AS s FROM runs WHERE camera_id IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL),
b AS (SELECT camera_id, detector, day, f / s AS fps FROM a WHERE s > 0)
SELECT *, first_value(fps) OVER w AS first_fps, fps < first_value(fps) OVER w * 0.9::DOUBLE AS degraded FROM b WINDOW w AS (PARTITION BY camera_id, detector ORDER BY day)"""


def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of each five seconds of a camera, and whether a minute has passed since its first frame."""
    d = detections(spark, sf_dir, "camera_id", "frame_index", "ts").where("camera_id IS NOT NULL AND ts IS NOT NULL").withColumn("t_ms", to_ms(F.col("ts")))
    f = d.groupBy("camera_id", F.floor(F.col("t_ms") / 5000).alias("slot")).agg(F.min(F.struct("t_ms", "frame_index")).alias("r"))
    first = f.groupBy("camera_id").agg(F.min("r.t_ms").alias("t0"))
    return f.join(first, "camera_id").select("camera_id", "slot", "r.t_ms", "r.frame_index", (F.col("r.t_ms") - F.col("t0") >= 60000).alias("gate_valid"))


_SAMPLED_SQL = (
    "WITH "
    + _ONCE
    + """, a AS (SELECT camera_id, frame_index, round(ts * 1000)::BIGINT AS t_ms FROM once WHERE camera_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, t_ms // 5000 AS slot, min(t_ms) OVER (PARTITION BY camera_id) AS t0 FROM a)
SELECT camera_id, slot, t_ms, frame_index, t_ms - t0 >= 60000 AS gate_valid FROM b QUALIFY row_number() OVER (PARTITION BY camera_id, slot ORDER BY t_ms, frame_index) = 1"""
)


def queries() -> dict:
    return {
        "clip_names": clip_names,
        "clip_scores": clip_scores_query,
        "gate_status": gate_status_query,
        "label_peaks": label_peaks,
        "smoke_verdict": smoke_verdict,
        "timed_run": timed_run,
        "timed_trials": timed_trials,
        "threshold_sweep": sweep_query,
        "threshold_choice": choice_query,
        "rolling_latency": rolling_latency,
        "median_kinds": median_kinds,
        "stage_share": stage_share,
        "run_fps": run_fps,
        "degradation": degradation,
        "sampled_frames": sampled_frames,
    }


def oracle_sql() -> dict:
    return {
        "clip_names": _CLIP_NAMES_SQL,
        "clip_scores": _SCORES_SQL,
        "gate_status": _gates_sql(),
        "label_peaks": _PEAKS_SQL,
        "smoke_verdict": _VERDICT_SQL,
        "timed_run": _TIMED_SQL,
        "timed_trials": _TRIALS_SQL,
        "threshold_sweep": _SWEEP_SQL + "SELECT * FROM sweep",
        "threshold_choice": _CHOICE_SQL,
        "rolling_latency": _ROLLING_SQL,
        "median_kinds": f"WITH {_RUNS} SELECT run_id, detector, list_median(v) / 10.0::DOUBLE AS median_ms, list_sort(v)[len(v) // 2 + 1] / 10.0::DOUBLE AS upper_median_ms FROM vals WHERE len(v) > 0",
        "stage_share": _SHARE_SQL,
        "run_fps": _FPS_SQL,
        "degradation": _DEGRADED_SQL,
        "sampled_frames": _SAMPLED_SQL,
    }
