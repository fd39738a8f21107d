"""Queries on the life of events, over sightings derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.lifecycle import EventRule, confirmations, cooldown_slots, lifecycle, open_sessions, session_summary
from sightline.sources.tables import table

BASIC = EventRule(confirm_hits=3, confirm_window_s=7200, close_after_s=7200, cooldown_s=86400)
STREAK = EventRule(confirm_hits=3, confirm_window_s=14400, close_after_s=10800, cooldown_s=43200, min_duration_s=7200, max_gap_s=5400)


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sighting per row of ``events``: 40 users make a camera, the type is the label."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("cam"), F.expr("user_id div 40")).alias("camera_id"), F.col("event_type"), F.lit(None).cast("string").alias("subject"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"), (F.least("value", F.lit(100.0)) / F.lit(100.0)).alias("confidence"),
    )


_CAND = "cand AS (SELECT 'cam' || (user_id // 40) AS camera_id, event_type, epoch_us(ts) AS ts_us, event_id AS seq, least(value, 100.0) / 100.0 AS confidence FROM events)"


def _sessions_sql(rule: EventRule) -> str:
    gap, window, duration = rule.us("max_gap"), rule.us("confirm_window"), rule.us("min_duration")
    broken = f"CASE WHEN ts_us - lag(ts_us) OVER s > {gap} THEN 1 ELSE 0 END" if duration else "0"
    long = f"AND ts_us - min(ts_us) OVER (PARTITION BY camera_id, event_type, session, streak) >= {duration}" if duration else ""
    return f"""{_CAND},
f AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY camera_id, event_type ORDER BY ts_us, seq) < {rule.us("close_after")} THEN 0 ELSE 1 END AS fresh FROM cand),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY camera_id, event_type ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS sid FROM f),
h AS (SELECT *, min(ts_us) OVER (PARTITION BY camera_id, event_type, sid) AS session FROM g),
b AS (SELECT *, {broken} AS broken FROM h WINDOW s AS (PARTITION BY camera_id, event_type, session ORDER BY ts_us, seq)),
k AS (SELECT *, sum(broken) OVER (PARTITION BY camera_id, event_type, session ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS streak FROM b),
m AS (SELECT *, coalesce(ts_us - lag(ts_us, {rule.confirm_hits - 1}) OVER (PARTITION BY camera_id, event_type, session, streak ORDER BY ts_us, seq) <= {window} {long}, false) AS meets FROM k),
s AS (SELECT camera_id, event_type, session AS started_us, max(ts_us) AS last_us, count(*) AS hits, arg_max(confidence, {{'c': confidence, 's': seq}}) AS peak_confidence, arg_max(seq, {{'c': confidence, 's': seq}}) AS peak_seq,
  min(ts_us) FILTER (WHERE meets) AS confirm_us, list(ts_us ORDER BY ts_us, seq) AS seen FROM m GROUP BY camera_id, event_type, session)"""


_SESSION = ["camera_id", "event_type", "started_us", "last_us", "hits", "peak_confidence", "peak_seq"]


def event_sessions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_summary(confirmations(sightings(spark, sf_dir), BASIC)).select(*_SESSION)


def _confirm(rule: EventRule):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session_summary(confirmations(sightings(spark, sf_dir), rule)).select("camera_id", "event_type", "started_us", "confirm_us")

    return query


def _life(rule: EventRule):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lifecycle(sightings(spark, sf_dir), rule).select(*_SESSION, "confirm_us", "outcome", "notified_us", "closed_us")

    return query


def _life_sql(rule: EventRule) -> str:
    cd = rule.us("cooldown")
    return f"""WITH RECURSIVE {_sessions_sql(rule)},
ev AS (SELECT *, list_filter(seen, lambda t: t > confirm_us) AS later, row_number() OVER (PARTITION BY camera_id, event_type ORDER BY started_us) AS rn FROM s WHERE confirm_us IS NOT NULL),
fold AS (
  SELECT camera_id, event_type, rn, 'CONFIRMED' AS outcome, confirm_us AS notified_us, confirm_us AS last FROM ev WHERE rn = 1
  UNION ALL
  SELECT camera_id, event_type, rn, outcome, CASE WHEN outcome <> 'SUPPRESSED' THEN moment END, CASE WHEN outcome <> 'SUPPRESSED' THEN moment ELSE last END FROM (
    SELECT e.camera_id, e.event_type, e.rn, f.last,
      CASE WHEN e.confirm_us - f.last >= {cd} THEN 'CONFIRMED' WHEN len(list_filter(e.later, lambda t: t - f.last >= {cd})) > 0 THEN 'PROMOTED' ELSE 'SUPPRESSED' END AS outcome,
      CASE WHEN e.confirm_us - f.last >= {cd} THEN e.confirm_us ELSE list_filter(e.later, lambda t: t - f.last >= {cd})[1] END AS moment
    FROM fold f JOIN ev e ON e.camera_id = f.camera_id AND e.event_type = f.event_type AND e.rn = f.rn + 1))
SELECT {", ".join("ev." + c for c in _SESSION)}, ev.confirm_us, fold.outcome, fold.notified_us, ev.last_us + {rule.us("close_after")} AS closed_us
FROM ev JOIN fold USING (camera_id, event_type, rn)"""



def open_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that are open at the middle of the table's time span."""
    base = sightings(spark, sf_dir)
    now = base.agg(F.expr("(min(ts_us) + max(ts_us)) div 2")).first()[0]
    summary = session_summary(confirmations(base, BASIC))
    return open_sessions(summary, now or 0, BASIC).select(*_SESSION)


def global_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sightings that claim the one slot of a camera for all its types."""
    return cooldown_slots(sightings(spark, sf_dir), ["camera_id"], "ts_us", "seq", 3600_000_000)


def legacy_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant whose slot moves only on success and whose distance must exceed the cooldown."""
    s = sightings(spark, sf_dir).withColumn("sent", F.col("seq") % 3 != 0)
    return cooldown_slots(s, ["camera_id", "event_type"], "ts_us", "seq", 7200_000_000, inclusive=False, success="sent")


def _slots_sql(keys: list[str], cooldown: int, op: str, ok: str) -> str:
    by, same = ", ".join(keys), " AND ".join(f"c.{k} = w.{k}" for k in keys)
    return f"""WITH RECURSIVE {_CAND},
c AS (SELECT *, {ok} AS ok, row_number() OVER (PARTITION BY {by} ORDER BY ts_us, seq) AS rn FROM cand),
w AS (
  SELECT {by}, rn, ts_us, seq, true AS free, CASE WHEN ok THEN ts_us END AS last FROM c WHERE rn = 1
  UNION ALL
  SELECT {", ".join("c." + k for k in keys)}, c.rn, c.ts_us, c.seq, w.last IS NULL OR c.ts_us - w.last {op} {cooldown}, CASE WHEN (w.last IS NULL OR c.ts_us - w.last {op} {cooldown}) AND c.ok THEN c.ts_us ELSE w.last END
  FROM w JOIN c ON {same} AND c.rn = w.rn + 1)
SELECT {by}, ts_us, seq FROM w WHERE free"""


def queries() -> dict:
    return {
        "event_sessions": event_sessions_query,
        "event_confirm": _confirm(BASIC),
        "event_confirm_streak": _confirm(STREAK),
        "event_lifecycle": _life(BASIC),
        "event_lifecycle_streak": _life(STREAK),
        "open_events": open_events,
        "global_cooldown": global_cooldown,
        "legacy_cooldown": legacy_cooldown,
    }


def oracle_sql() -> dict:
    confirm = "SELECT camera_id, event_type, started_us, confirm_us FROM s"
    basic = _sessions_sql(BASIC)
    return {
        "event_sessions": f"WITH {basic} SELECT {', '.join(_SESSION)} FROM s",
        "event_confirm": f"WITH {basic} {confirm}",
        "event_confirm_streak": f"WITH {_sessions_sql(STREAK)} {confirm}",
        "event_lifecycle": _life_sql(BASIC),
        "event_lifecycle_streak": _life_sql(STREAK),
        "open_events": f"WITH {basic}, now AS (SELECT (min(ts_us) + max(ts_us)) // 2 AS t FROM cand) SELECT {', '.join(_SESSION)} FROM s, now WHERE started_us <= t AND last_us + {BASIC.us('close_after')} > t",
        "global_cooldown": _slots_sql(["camera_id"], 3600_000_000, ">=", "true"),
        "legacy_cooldown": _slots_sql(["camera_id", "event_type"], 7200_000_000, ">", "seq % 3 <> 0"),
    }
