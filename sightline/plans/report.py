"""Queries on the event log: versions, report, funnel, routing, messages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.text import event_type_key
from sightline.operators.dedupe import latest_version
from sightline.operators.report import Route, explain, funnel, funnel_line, in_period, message, outbox, safe_name, snapshot_name
from sightline.sources.tables import table

#: Seconds for which a key stays quiet after a notification.
COOLDOWNS, DEFAULT_COOLDOWN = {"smoke": 60.0}, 30.0
ROUTES = [Route(("console", "file")), Route(("mail", "console"), None, "MEDIUM"), Route(("siren", "pager"), ("fight", "hazard_object"), "HIGH")]
ENABLED = ["console", "mail", "siren"]
SINCE, UNTIL = 1767600000.0, 1769000000.0

_WANTED = ["event_type", "severity", "status", "camera_id", "subject", "started_at", "last_seen_at", "confirmed_at", "hit_count", "peak_confidence", "peak_label", "snapshot_path", "notifications"]
_LAST = "latest AS (SELECT * REPLACE (replace(replace(lower(trim(event_type)), '-', '_'), ' ', '_') AS event_type) FROM event_log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY log_seq DESC) = 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event by its last written version."""
    log = table(spark, sf_dir, "event_log").select("event_id", "log_seq", *_WANTED)
    return latest_version(log, ["event_id"], "log_seq").withColumn("event_type", event_type_key(F.col("event_type")))


def event_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "log_seq", "event_type", "status", "hit_count", "started_at")


def event_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event by id; the filter reaches the scan, before the versions are compared."""
    log = table(spark, sf_dir, "event_log")
    wanted = log.agg(F.min("event_id")).first()[0]
    one = log.where(F.col("event_id") == wanted).select("event_id", "log_seq", "status", "hit_count")
    return latest_version(one, ["event_id"], "log_seq")


def event_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 events of one type that began last."""
    e = events(spark, sf_dir).where("event_type = 'fight' AND started_at IS NOT NULL")
    return e.orderBy(F.desc("started_at"), "event_id").limit(100).select("event_id", "started_at", "camera_id")


def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain(events(spark, sf_dir), COOLDOWNS, DEFAULT_COOLDOWN).select("event_id", "event_type", "outcome", "reason", "t")


def event_report_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain(in_period(events(spark, sf_dir), SINCE, UNTIL, "smoking"), COOLDOWNS, DEFAULT_COOLDOWN).select("event_id", "event_type", "outcome", "reason", "t")


def _report_sql(where: str) -> str:
    return f"""WITH {_LAST},
o AS (SELECT *, CASE WHEN len(list_filter(notifications, lambda d: coalesce(d.success, false))) > 0 THEN 'SENT' WHEN len(notifications) > 0 THEN 'SEND FAILED' ELSE 'NOT SENT' END AS outcome,
  coalesce(nullif(confirmed_at, 0), started_at) AS t FROM latest WHERE {where}),
a AS (SELECT *, last_value(CASE WHEN outcome <> 'NOT SENT' THEN t END IGNORE NULLS) OVER (PARTITION BY camera_id, event_type, subject, t IS NULL ORDER BY t, started_at NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_t FROM o)
SELECT event_id, event_type, outcome, t, CASE outcome
  WHEN 'SENT' THEN array_to_string(list_transform(list_filter(notifications, lambda d: coalesce(d.success, false)), lambda d: d.channel), ',')
  WHEN 'SEND FAILED' THEN array_to_string(list_transform(notifications, lambda d: d.channel || ': ' || coalesce(nullif(d.error, ''), 'failed')), '; ')
  ELSE CASE WHEN t - last_t >= 0 AND t - last_t < CASE event_type WHEN 'smoke' THEN 60.0 ELSE 30.0 END THEN 'cooldown' ELSE 'unknown' END END AS reason
FROM a"""


def event_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel(events(spark, sf_dir)).withColumn("line", funnel_line())


_FUNNEL_SQL = f"""WITH {_LAST},
o AS (SELECT *, CASE WHEN len(list_filter(notifications, lambda d: coalesce(d.success, false))) > 0 THEN 'SENT' WHEN len(notifications) > 0 THEN 'SEND FAILED' ELSE 'NOT SENT' END AS o FROM latest)
SELECT *, 'seen ' || format('{{:,}}', sightings) || ' times -> ' || events || ' events -> ' || sent || ' alerts sent' AS line FROM (
  SELECT CASE WHEN grouping(event_type) = 1 THEN 'ALL' ELSE event_type END AS event_type, sum(hit_count)::BIGINT AS sightings, count(*) AS events, count(*) FILTER (WHERE o = 'SENT') AS sent,
    count(*) FILTER (WHERE o = 'SEND FAILED') AS failed, count(*) FILTER (WHERE o = 'NOT SENT') AS not_sent
  FROM o GROUP BY ROLLUP (event_type))"""


def route_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox(events(spark, sf_dir), ROUTES, ENABLED).select("event_id", "channel")


_ROUTE_SQL = f"""WITH {_LAST},
r AS (SELECT event_id, event_type, list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], upper(trim(severity))) - 1 AS rank FROM latest)
SELECT event_id, unnest(list_distinct(list_concat(CASE WHEN rank >= 0 THEN ['console'] ELSE [] END, CASE WHEN rank >= 2 THEN ['mail', 'console'] ELSE [] END,
  CASE WHEN rank >= 3 AND event_type IN ('fight', 'hazard_object') THEN ['siren'] ELSE [] END))) AS channel FROM r"""


def alert_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message(events(spark, sf_dir), table(spark, sf_dir, "cameras").select("camera_id", "name"), {"fight": "Posture like a fight, please check"})


_MESSAGE_SQL = f"""WITH {_LAST},
m AS (SELECT l.*, c.name, coalesce(nullif(confirmed_at, 0), last_seen_at) AS w FROM latest l LEFT JOIN cameras c USING (camera_id))
SELECT event_id, substr(concat_ws(chr(10), CASE event_type WHEN 'fight' THEN 'Posture like a fight, please check' ELSE 'Event: ' || event_type END, 'label: ' || peak_label, 'zone: ' || nullif(subject, ''),
  'confidence: ' || CASE WHEN NOT isnan(peak_confidence) THEN floor(peak_confidence * 100 + 0.5)::BIGINT END || ' %', 'severity: ' || severity,
  'time: ' || strftime(to_timestamp(floor(w)) AT TIME ZONE 'UTC', '%d/%m/%Y %H:%M:%S'), 'camera: ' || coalesce(name, camera_id), CASE WHEN snapshot_path IS NOT NULL THEN 'snapshot saved' END), 1, 4900) AS text FROM m"""


def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", snapshot_name().alias("file"), safe_name(F.col("subject")).alias("safe_subject"))


_NAME = "coalesce(nullif(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x')"
_NAMES_SQL = f"""WITH {_LAST}
SELECT event_id, strftime(to_timestamp(floor(coalesce(nullif(confirmed_at, 0), last_seen_at))) AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') || '_' || {_NAME.format("camera_id")} || '_' || {_NAME.format("event_type")} || '_' || substr(event_id, 1, 8) || '.jpg' AS file,
  {_NAME.format("subject")} AS safe_subject FROM latest"""


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the stored JSON next to the columns they repeat; NULL where the text is broken."""
    log = table(spark, sf_dir, "event_log").select("log_seq", "data_json")
    j = F.from_json("data_json", "schema_version string, peak_detection struct<label:string,confidence:double>, model struct<weights:string>, hit_count bigint")
    return log.select("log_seq", j["schema_version"].alias("schema_version"), j["model"]["weights"].alias("weights"))


def queries() -> dict:
    return {
        "event_upsert": event_upsert,
        "event_get": event_get,
        "event_latest": event_latest,
        "event_report": event_report,
        "event_report_period": event_report_period,
        "event_funnel": event_funnel,
        "route_outbox": route_outbox,
        "alert_message": alert_message,
        "snapshot_names": snapshot_names,
        "event_json": event_json,
    }


def oracle_sql() -> dict:
    return {
        "event_upsert": f"WITH {_LAST} SELECT event_id, log_seq, event_type, status, hit_count, started_at FROM latest",
        "event_get": "SELECT event_id, log_seq, status, hit_count FROM event_log WHERE event_id = (SELECT min(event_id) FROM event_log) QUALIFY row_number() OVER (ORDER BY log_seq DESC) = 1",
        "event_latest": f"WITH {_LAST} SELECT event_id, started_at, camera_id FROM latest WHERE event_type = 'fight' AND started_at IS NOT NULL ORDER BY started_at DESC, event_id LIMIT 100",
        "event_report": _report_sql("true"),
        "event_report_period": _report_sql(f"started_at >= {SINCE} AND started_at < {UNTIL} AND event_type = 'smoking'"),
        "event_funnel": _FUNNEL_SQL,
        "route_outbox": _ROUTE_SQL,
        "alert_message": _MESSAGE_SQL,
        "snapshot_names": _NAMES_SQL,
        "event_json": "SELECT log_seq, CASE WHEN json_valid(data_json) THEN data_json->>'schema_version' END AS schema_version, CASE WHEN json_valid(data_json) THEN data_json->'model'->>'weights' END AS weights FROM event_log",
    }
