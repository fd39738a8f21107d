"""The report of an event log: outcomes, reasons, funnels; and the routing of events to channels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ordered import last_before

#: Severities in rising order.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_rank(severity: Column) -> Column:
    """The rank of a severity's name in any case; NULL for an unknown one."""
    return F.when(severity.isNotNull(), F.try_element_at(F.create_map(*(x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i)))), F.upper(F.trim(severity))))


def outcome(notifications: Column) -> Column:
    """SENT if a delivery succeeded, SEND FAILED if there were only failed ones, NOT SENT if there was none."""
    sent = F.coalesce(F.exists(notifications, lambda d: F.coalesce(d["success"], F.lit(False))), F.lit(False))
    tried = F.coalesce(F.size(notifications), F.lit(0)) > 0
    return F.when(sent, "SENT").when(tried, "SEND FAILED").otherwise("NOT SENT")


def sent_channels(notifications: Column) -> Column:
    return F.array_join(F.transform(F.filter(notifications, lambda d: F.coalesce(d["success"], F.lit(False))), lambda d: d["channel"]), ",")


def failures(notifications: Column) -> Column:
    empty_as_failed = lambda d: F.coalesce(F.when(d["error"] != "", d["error"]), F.lit("failed"))
    return F.array_join(F.transform(notifications, lambda d: F.concat(d["channel"], F.lit(": "), empty_as_failed(d))), "; ")


def in_period(log: DataFrame, since: float | None = None, until: float | None = None, event_type: str | None = None) -> DataFrame:
    """The events that began in [since, until), of one type if given."""
    for bound, op in ((since, ">="), (until, "<")):
        if bound is not None:
            log = log.where(f"started_at {op} {float(bound)!r}D")
    return log if event_type is None else log.where(F.col("event_type") == event_type)


def explain(log: DataFrame, cooldowns: dict[str, float], default: float) -> DataFrame:
    """``log`` (camera_id, event_type, subject, event_id, times, notifications) with ``outcome`` and ``reason``.

    An event that wasn't sent is explained by the last dispatched event of its key at or before it, if that is less than
    the type's cooldown away. Filter the period before: dispatches outside it are not seen. A time of 0 counts as none.
    """
    t = F.coalesce(F.when(F.col("confirmed_at") != 0, F.col("confirmed_at")), F.col("started_at"))
    rows = log.withColumns({"t": t, "outcome": outcome(F.col("notifications"))})
    rows = rows.withColumn("dispatched", F.when(F.col("outcome") != "NOT SENT", F.col("t")))
    slim = rows.select("camera_id", "event_type", "subject", "t", "started_at", "event_id", "dispatched", "outcome", sent_channels(F.col("notifications")).alias("channels"), failures(F.col("notifications")).alias("failed"))
    timed = last_before(slim, ["camera_id", "event_type", "subject"], "t", ["started_at", "event_id"], "dispatched", "last_t")
    untimed = slim.where("t IS NULL").withColumn("last_t", F.lit(None).cast("double"))
    limit = F.lit(float(default))
    for kind, seconds in cooldowns.items():
        limit = F.when(F.col("event_type") == kind, F.lit(float(seconds))).otherwise(limit)
    quiet = F.coalesce((F.col("t") - F.col("last_t") >= 0) & (F.col("t") - F.col("last_t") < limit), F.lit(False))
    reason = F.when(F.col("outcome") == "SENT", F.col("channels")).when(F.col("outcome") == "SEND FAILED", F.col("failed")).when(quiet, "cooldown").otherwise("unknown")
    return timed.unionByName(untimed).withColumn("reason", reason).drop("channels", "failed", "dispatched", "last_t")


def funnel(log: DataFrame) -> DataFrame:
    """Per event type, and for all ('ALL'), sightings, events and what was sent, in one pass."""
    o = outcome(F.col("notifications"))
    flat = log.select("event_type", "hit_count", o.alias("o"))
    rolled = flat.rollup("event_type").agg(
        F.sum("hit_count").alias("sightings"), F.count("*").alias("events"), F.count_if(F.col("o") == "SENT").alias("sent"), F.count_if(F.col("o") == "SEND FAILED").alias("failed"), F.count_if(F.col("o") == "NOT SENT").alias("not_sent"), F.grouping("event_type").alias("g")
    )
    return rolled.withColumn("event_type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("event_type"))).drop("g")


def funnel_line() -> Column:
    """The funnel as one sentence, over the columns of :func:`funnel`."""
    return F.concat(F.lit("seen "), F.format_number("sightings", 0), F.lit(" times -> "), F.col("events").cast("string"), F.lit(" events -> "), F.col("sent").cast("string"), F.lit(" alerts sent"))


@dataclass(frozen=True)
class Route:
    """Channels for the events of some types (None: all) from a severity on."""

    channels: tuple[str, ...]
    event_types: tuple[str, ...] | None = None
    min_severity: str = "INFO"

    @classmethod
    def parse(cls, data: dict) -> Route:
        types = data.get("event_types")
        types = None if types in (None, "*", ["*"]) else tuple(types)
        severity = str(data.get("min_severity", "INFO")).upper()
        if severity not in SEVERITIES:
            raise ValueError(f"unknown severity {severity!r}")
        return cls(tuple(data.get("channels") or ()), types, severity)


def targets(event_type: Column, severity: Column, routes: list[Route], enabled: list[str]) -> Column:
    """The enabled channels of all matching routes, each once, in the order of the routes."""
    rank, parts = severity_rank(severity), []
    for r in routes:
        known = [c for c in r.channels if c in enabled]
        if known:
            hit = rank >= SEVERITIES.index(r.min_severity)
            if r.event_types is not None:
                hit &= event_type.isin(list(r.event_types))
            parts.append(F.when(F.coalesce(hit, F.lit(False)), F.array(*map(F.lit, known))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def outbox(events: DataFrame, routes: list[Route], enabled: list[str]) -> DataFrame:
    """One row per event and channel that it goes to."""
    return events.withColumn("channel", F.explode(targets(F.col("event_type"), F.col("severity"), routes, enabled)))


def message(events: DataFrame, cameras: DataFrame, titles: dict[str, str] | None = None, most: int = 4900) -> DataFrame:
    """``event_id`` and ``text``: the alert's lines, those without content left out, cut to a channel's length.

    ``cameras``: camera_id, name; an id without a name stands for itself.
    """
    named = events.join(cameras.select("camera_id", F.col("name").alias("camera_name")), "camera_id", "left")
    title = F.concat(F.lit("Event: "), F.col("event_type"))
    for kind, text in (titles or {}).items():
        title = F.when(F.col("event_type") == kind, F.lit(text)).otherwise(title)
    when = F.coalesce(F.when(F.col("confirmed_at") != 0, F.col("confirmed_at")), F.col("last_seen_at"))
    percent = F.floor(F.col("peak_confidence") * 100 + F.lit(0.5)).cast("string")
    lines = F.concat_ws(
        "\n", title, F.concat(F.lit("label: "), F.col("peak_label")), F.concat(F.lit("zone: "), F.when(F.col("subject") != "", F.col("subject"))), F.concat(F.lit("confidence: "), F.when(~F.isnan("peak_confidence"), percent), F.lit(" %")),
        F.concat(F.lit("severity: "), F.col("severity")), F.concat(F.lit("time: "), F.date_format(F.timestamp_seconds(F.floor(when)), "dd/MM/yyyy HH:mm:ss")),
        F.concat(F.lit("camera: "), F.coalesce("camera_name", "camera_id")), F.when(F.col("snapshot_path").isNotNull(), F.lit("snapshot saved")),
    )
    return named.select("event_id", F.substring(lines, 1, most).alias("text"))


def safe_name(text: Column) -> Column:
    """The text with every run of characters other than letters, digits, '_', '.' and '-' as '-'; 'x' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit("x"))


def snapshot_name() -> Column:
    """The file name of an event's picture, from its time, camera, type and id."""
    when = F.coalesce(F.when(F.col("confirmed_at") != 0, F.col("confirmed_at")), F.col("last_seen_at"))
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(when)), "yyyyMMdd_HHmmss"), F.lit("_"), safe_name(F.col("camera_id")), F.lit("_"), safe_name(F.col("event_type")), F.lit("_"), F.substring("event_id", 1, 8), F.lit(".jpg"))
