"""Queries of the training-data problems, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import event_type_key, letters_key, to_ms
from sightline.llm.bpe import encode_texts
from sightline.llm.digests import certified, digests, merge_digests
from sightline.llm.leaks import find_leaks, removal_spans
from sightline.llm.runs import collapse_runs
from sightline.llm.splits import deal, linked_sets, path_keys, record_forest, split_key, torn_sets
from sightline.llm.subjects import classify, train
from sightline.sources.tables import once, table

#: The folder of tokenizer files; SIGHTLINE_TOKENIZERS names another.
TOKENIZERS = os.environ.get("SIGHTLINE_TOKENIZERS", "/opt/tokenizers")
MAX_GAP_MS = 5000


def _run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each (run_id, detector) once, by its first delivery, without shuffling the arrays."""
    return once(spark, sf_dir, "run_stats", ["run_id", "detector"], "ingested_at", "started_at", "infer_ms")


def _day(seconds: str):  # noqa: ANN202
    s = F.col(seconds)
    return F.when(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < 1e11), F.date_from_unix_date(F.floor(s / 86400).cast("int")))


def p1_infer_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the inference times per detector and UTC day, with the digests to merge later."""
    keys = {"detector": F.col("detector"), "day": _day("started_at")}
    return certified(_run_stats(spark, sf_dir), keys, F.col("infer_ms"))


def p1_infer_all_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the inference times per detector, merged from the digests of its days."""
    runs = _run_stats(spark, sf_dir)
    days = digests(runs, {"detector": F.col("detector"), "day": _day("started_at")}, F.col("infer_ms"))
    return certified(runs, {"detector": F.col("detector")}, F.col("infer_ms"), merge_digests(days, ["detector"]))


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the peak confidence per event type, each event by its last written row."""
    log = table(spark, sf_dir, "event_log").groupBy("event_id").agg(F.max(F.struct("log_seq", "event_type", "peak_confidence")).alias("r"))
    last = log.select("r.event_type", "r.peak_confidence")
    return certified(last, {"event_type": event_type_key(F.col("event_type"))}, F.array("peak_confidence"))


def _runs(spark: SparkSession, sf_dir: str, similarity: float) -> DataFrame:
    d = table(spark, sf_dir, "detections")
    return collapse_runs(d, F.col("camera_id"), F.col("det_id"), [F.col("ts"), F.col("module_order"), F.col("det_idx")], to_ms(F.col("ts")), letters_key(F.col("label")), F.col("ingested_at"), MAX_GAP_MS, similarity)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of two or more detections of one label on one camera."""
    duration = (F.col("last_ms") - F.col("first_ms")).alias("duration_ms")
    return _runs(spark, sf_dir, 1.0).where("n >= 2").select(F.col("entity").alias("camera_id"), F.col("first_id").alias("first_det_id"), F.col("last_id").alias("last_det_id"), F.col("n").alias("n_detections"), duration)


def p4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sequence of each camera, collapsed with labels that share most of their letters taken as near-equal."""
    duration = (F.col("last_ms") - F.col("first_ms")).alias("duration_ms")
    return _runs(spark, sf_dir, 0.6).select(F.col("entity").alias("camera_id"), F.col("first_id").alias("first_det_id"), F.col("last_id").alias("last_det_id"), F.col("n").alias("n_detections"), duration, "labels")


P4_SQL = """
WITH once AS (
  SELECT det_id, camera_id, ts, module_order, det_idx, lower(regexp_replace(label, '[^A-Za-z]', '', 'g')) AS k
  FROM detections WHERE camera_id IS NOT NULL AND ts IS NOT NULL AND label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY ingested_at) = 1),
seq AS (
  SELECT *, CAST(round(ts * 1000) AS BIGINT) AS ms, row_number() OVER w AS rn,
         CASE WHEN lag(k) OVER w = k AND CAST(round(ts * 1000) AS BIGINT) - lag(CAST(round(ts * 1000) AS BIGINT)) OVER w <= 5000 THEN 0 ELSE 1 END AS fresh
  FROM once WHERE k <> '' WINDOW w AS (PARTITION BY camera_id ORDER BY ts, module_order, det_idx, det_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM seq)
SELECT camera_id, arg_min(det_id, rn) AS first_det_id, arg_max(det_id, rn) AS last_det_id, count(*) AS n_detections, max(ms) - min(ms) AS duration_ms
FROM runs GROUP BY camera_id, run HAVING count(*) >= 2
"""


def _clip_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_sets(table(spark, sf_dir, "clips"), F.col("clip_id"), path_keys(F.col("path")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clips of the sets that today's splits tear apart."""
    splits = table(spark, sf_dir, "clips").select(F.col("clip_id").alias("id"), split_key(F.col("split")).alias("split"))
    return torn_sets(_clip_sets(spark, sf_dir), splits).withColumnRenamed("id", "clip_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip with its set and its new split."""
    return deal(_clip_sets(spark, sf_dir)).withColumnRenamed("id", "clip_id")


def p5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest that holds the sets together: clips and the recordings and performers they hang on."""
    return record_forest(table(spark, sf_dir, "clips"), F.col("clip_id"), path_keys(F.col("path"))).select(F.col("id").alias("clip_id"), "key")


P5_SQL = """
WITH RECURSIVE keys AS (
  SELECT DISTINCT clip_id, regexp_replace(regexp_replace(k, '[ _-]', '', 'g'), '^(rec|act)0+([0-9])', '\\1\\2') AS k
  FROM (SELECT clip_id, unnest(regexp_extract_all(lower(path), '(?:rec|act)[ _-]?[0-9]+')) AS k FROM clips)),
near AS (SELECT DISTINCT a.clip_id AS x, b.clip_id AS y FROM keys a JOIN keys b USING (k)),
reach AS (SELECT DISTINCT clip_id AS x, clip_id AS y FROM clips UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
sets AS (SELECT x AS clip_id, min(y) AS set_id FROM reach GROUP BY x),
named AS (
  SELECT clip_id, CASE s WHEN 'tune' THEN 'train' WHEN 'valid' THEN 'val' WHEN 'validation' THEN 'val' ELSE s END AS s
  FROM (SELECT clip_id, lower(trim(split)) AS s FROM clips) WHERE s IS NOT NULL AND s <> ''),
torn AS (SELECT set_id FROM sets JOIN named USING (clip_id) GROUP BY set_id HAVING count(DISTINCT s) > 1)
SELECT clip_id, set_id FROM sets WHERE set_id IN (SELECT set_id FROM torn)
"""


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.json")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that repeat at least half of an evaluation item's words in passages."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged word spans to remove from each document that repeats an item."""
    return removal_spans(_leaks(spark, sf_dir), "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas of each document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, "doc_id", "text", table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subjects"))
    return classify(docs, "doc_id", "text", model).select("doc_id", "subject")


def queries() -> dict:
    return {
        "p1_infer_ms": p1_infer_ms,
        "p1_infer_all_days": p1_infer_all_days,
        "p1_confidence": p1_confidence,
        "p4_found": p4_found,
        "p4_near": p4_near,
        "p5_found": p5_found,
        "p5_splits": p5_splits,
        "p5_forest": p5_forest,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_spans": p7_spans,
        "p8_found": p8_found,
    }


def oracle_sql() -> dict:
    return {"p4_found": P4_SQL, "p5_found": P5_SQL}
