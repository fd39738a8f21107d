"""The life of events as a stateful streaming query, with the rules of the batch query.

State is kept per key (camera, type, subject): the open event, the recent sightings that may confirm it, the streak, and
the last notification, which outlives the event. Rows of a micro-batch are taken in time order; a row older than the
key's last sighting is late and dropped. An event is emitted when it closes: at the first sighting after the silence, or
by a timer once the watermark has passed it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.operators.lifecycle import KEY, EventRule

OUTPUT = T.StructType(
    [
        *(T.StructField(k, T.StringType()) for k in KEY),
        *(T.StructField(c, T.LongType()) for c in ("started_us", "last_us", "hits")),
        T.StructField("peak_confidence", T.DoubleType()),
        T.StructField("peak_seq", T.LongType()),
        T.StructField("confirm_us", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("notified_us", T.LongType()),
        T.StructField("closed_us", T.LongType()),
    ]
)


class EventState:
    """One key's state and its transitions; plain Python, shared with tests."""

    def __init__(self, rule: EventRule, data: dict | None = None) -> None:
        self.rule, self.event, self.last_notified = rule, None, None
        if data:
            self.event, self.last_notified = data["event"], data["last_notified"]

    def data(self) -> dict:
        return {"event": self.event, "last_notified": self.last_notified}

    def see(self, t: int, seq: int, confidence: float) -> dict | None:
        """Take a sighting; give the event it closed, if that was confirmed."""
        closed = None
        if self.event is not None and t - self.event["last"] >= self.rule.us("close_after"):
            closed = self.close()
        if self.event is None:
            self.event = {"start": t, "last": t, "hits": 0, "peak": None, "seq": None, "recent": [], "streak": t, "confirm": None, "outcome": None, "notified": None}
        e = self.event
        if t < e["last"]:
            return closed
        gap = t - e["last"]
        e["last"], e["hits"] = t, e["hits"] + 1
        if e["peak"] is None or confidence >= e["peak"]:
            e["peak"], e["seq"] = confidence, seq
        if e["outcome"] is None:
            self._confirm(t, gap)
        elif e["outcome"] == "SUPPRESSED" and t - self.last_notified >= self.rule.us("cooldown"):
            e["outcome"], e["notified"], self.last_notified = "PROMOTED", t, t
        return closed

    def _confirm(self, t: int, gap: int) -> None:
        e, r = self.event, self.rule
        if r.min_duration_s > 0 and e["recent"] and gap > r.us("max_gap"):
            e["recent"], e["streak"] = [], t
        e["recent"] = [x for x in e["recent"] if t - x <= r.us("confirm_window")] + [t]
        if len(e["recent"]) < r.confirm_hits or (r.min_duration_s > 0 and t - e["streak"] < r.us("min_duration")):
            return
        e["confirm"], e["recent"] = t, []
        if self.last_notified is not None and t - self.last_notified < r.us("cooldown"):
            e["outcome"] = "SUPPRESSED"
        else:
            e["outcome"], e["notified"], self.last_notified = "CONFIRMED", t, t

    def close(self) -> dict | None:
        """End the open event; give it if it was confirmed."""
        e, self.event = self.event, None
        if e is None or e["outcome"] is None:
            return None
        return {"started_us": e["start"], "last_us": e["last"], "hits": e["hits"], "peak_confidence": e["peak"], "peak_seq": e["seq"], "confirm_us": e["confirm"], "outcome": e["outcome"], "notified_us": e["notified"], "closed_us": e["last"] + self.rule.us("close_after")}


class EventProcessor(StatefulProcessor):
    """Keeps an :class:`EventState` per key in the state store."""

    def __init__(self, rule: EventRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("event", T.StructType([T.StructField("json", T.StringType())]))

    def _load(self) -> EventState:
        return EventState(self.rule, json.loads(self.state.get()[0]) if self.state.exists() else None)

    def _frame(self, key: tuple, rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame([dict(zip(KEY, key)) | r for r in rows], columns=OUTPUT.names)
        return out.astype({c: "Int64" for c in ("started_us", "last_us", "hits", "peak_seq", "confirm_us", "notified_us", "closed_us")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state, out = self._load(), []
        seen = pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")
        for t, s, c in zip(seen["ts_us"].tolist(), seen["seq"].tolist(), seen["confidence"].tolist()):
            if done := state.see(t, s, c):
                out.append(done)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state.event is not None:
            self.handle.registerTimer((state.event["last"] + self.rule.us("close_after")) // 1000 + 1)
        self.state.update((json.dumps(state.data()),))
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        state = self._load()
        done = state.close()
        self.state.update((json.dumps(state.data()),))
        if done:
            yield self._frame(key, [done])

    def close(self) -> None:
        pass


def lifecycle_stream(candidates: DataFrame, rule: EventRule, lateness: str = "1 minute") -> DataFrame:
    """Closed events of a stream of candidates (key, ts_us, seq, confidence); needs the RocksDB state store."""
    timed = candidates.select(*(F.coalesce(k, F.lit("")).alias(k) for k in KEY), "ts_us", "seq", "confidence", F.timestamp_micros("ts_us").alias("event_time")).withWatermark("event_time", lateness)
    return timed.groupBy(*KEY).transformWithStateInPandas(EventProcessor(rule), OUTPUT, "Append", "EventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def windowed_counts(detections: DataFrame, size: str = "1 minute", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Detections per camera, label and window of event time, with late rows taken up to ``lateness``."""
    timed = detections.withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", size, slide), "camera_id", "label").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def session_counts(detections: DataFrame, gap: str = "10 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Detections per camera, label and session of event time: rows closer than ``gap`` belong together."""
    timed = detections.withWatermark("event_time", lateness)
    return timed.groupBy(F.session_window("event_time", gap), "camera_id", "label").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def joined_streams(events: DataFrame, records: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Two streams joined: events (event_id, event_time, ...) with the records of their deliveries (event_id, sent_at, ...)
    of the time ``within`` after them; events without any come once the watermark has passed."""
    e = events.withWatermark("event_time", lateness)
    r = records.withColumnRenamed("event_id", "of_event").withWatermark("sent_at", lateness)
    near = F.expr(f"event_id = of_event AND sent_at >= event_time AND sent_at <= event_time + INTERVAL {within}")
    return e.join(r, near, "leftOuter").drop("of_event")
