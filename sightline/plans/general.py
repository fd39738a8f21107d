"""Queries of the general data problems: nested records (p2) and intervals (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.text import event_type_key, to_ms
from sightline.operators.intervals import merge_intervals, within_day
from sightline.operators.nested import child_table, flatten_json
from sightline.sources.tables import table

#: Fields of an event's JSON in which a lone object counts as an array of one (fixed by the data's definition).
LONE_FIELDS = ("notifications", "deliveries", "attempts", "errors", "people", "path", "wrists", "samples", "zones", "visits", "keypoints")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an element of an array in ``event_log.data_json``, with its link."""
    return flatten_json(table(spark, sf_dir, "event_log"), "log_seq", "data_json", LONE_FIELDS)


def p2_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed child table of delivery attempts, under either name of the deliveries."""
    flat = flatten_json(table(spark, sf_dir, "event_log"), "log_seq", "data_json", LONE_FIELDS, with_record=True)
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("at", T.DoubleType()), T.StructField("code", T.IntegerType())])
    flat = flat.where(F.col("table_path").isin("notifications[].attempts[]", "deliveries[].attempts[]"))
    return child_table(flat.withColumn("table_path", F.lit("attempts")), "attempts", schema)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods of events per camera and type, and the gaps between them within a UTC day."""
    log = table(spark, sf_dir, "event_log").where("camera_id IS NOT NULL")
    keys = {"camera_id": F.col("camera_id"), "event_type": event_type_key(F.col("event_type"))}
    return within_day(merge_intervals(log, keys, to_ms(F.col("started_at")), to_ms(F.coalesce("closed_at", "last_seen_at"))))


P3_SQL = """
WITH iv AS (
  SELECT camera_id, replace(replace(lower(trim(event_type)), '-', '_'), ' ', '_') AS event_type,
         CAST(round(started_at * 1000) AS BIGINT) AS s, CAST(round(coalesce(closed_at, last_seen_at) * 1000) AS BIGINT) AS e
  FROM event_log WHERE camera_id IS NOT NULL AND started_at IS NOT NULL),
flagged AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY camera_id, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 THEN 0 ELSE 1 END AS fresh
  FROM iv WHERE e >= s),
labelled AS (
  SELECT *, sum(fresh) OVER (PARTITION BY camera_id, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
periods AS (
  SELECT camera_id, event_type, min(s) AS start_ms, max(e) AS end_ms FROM labelled GROUP BY camera_id, event_type, island),
gaps AS (
  SELECT camera_id, event_type, end_ms AS start_ms,
         lead(start_ms) OVER (PARTITION BY camera_id, event_type ORDER BY start_ms) AS end_ms
  FROM periods)
SELECT camera_id, event_type, 'period' AS kind, start_ms, end_ms FROM periods
UNION ALL
SELECT camera_id, event_type, 'gap', start_ms, end_ms FROM gaps
WHERE end_ms IS NOT NULL AND start_ms // 86400000 = end_ms // 86400000
"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_attempts": p2_attempts, "p3_found": p3_found}


def oracle_sql() -> dict:
    return {"p3_found": P3_SQL}
