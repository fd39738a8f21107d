"""Channels that events are sent through, the queue in front of them, and the sink that drains it.

The queue is the outbox, a stream of rows event_id, channel, text (and snapshot_path). The sink sends a batch where its
rows are, records each attempt under the batch's number, and never stops for a channel. A batch that comes again after
it was recorded is not sent again, nor is an event whose record in an earlier batch says it reached the channel. Between
sending and recording a loss can repeat a message (at least once), never lose one.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, TextIO

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a channel makes of rows (dicts of the outbox): for each whether it was sent, and the error.
Channel = Callable[[list[dict]], list[tuple[bool, str | None]]]

RECORD = "event_id string, channel string, success boolean, error string"
#: Fixed value: characters of a pushed text.
PUSH_CHARS = 4900
#: What the answers of a push service mean.
PUSH_ERRORS = {401: "unauthorized", 403: "forbidden", 429: "rate limited"}


@dataclass
class ConsoleChannel:
    """Writes messages between rules; to the task's standard output unless told otherwise."""

    stream: TextIO | None = None

    def __call__(self, rows: list[dict]) -> list[tuple[bool, str | None]]:
        out = self.stream or sys.stdout
        for r in rows:
            shot = f"\n(snapshot: {r['snapshot_path']})" if r.get("snapshot_path") else ""
            print(f"{'-' * 40}\n{r['text']}{shot}\n{'-' * 40}", file=out, flush=True)
        return [(True, None)] * len(rows)


@dataclass
class PushChannel:
    """Posts messages through ``post(token, receiver, text)``, which gives the answer's status and body. Never raises."""

    post: Callable[[str, str, str], tuple[int, str]]
    token: str | None = None
    receiver: str | None = None

    def __call__(self, rows: list[dict]) -> list[tuple[bool, str | None]]:
        return [self.send(r["text"] or "") for r in rows]

    def send(self, text: str) -> tuple[bool, str | None]:
        if not (self.token and self.receiver):
            return False, "credentials missing"
        try:
            status, body = self.post(self.token, self.receiver, text[:PUSH_CHARS])
        except Exception as e:  # noqa: BLE001
            return False, f"{type(e).__name__}: {e}"
        if status == 200:
            return True, None
        said = f"{status} {PUSH_ERRORS[status]}" if status in PUSH_ERRORS else f"HTTP {status}"
        return False, f"{said}. {body.strip()[:200] or '(no body)'}"


def sent(batch: DataFrame, channels: dict[str, Channel]) -> DataFrame:
    """Send the rows of an outbox; a record for each. A channel that fails makes failed records of its rows."""
    rows = batch.select("event_id", "channel", "text", (F.col("snapshot_path") if "snapshot_path" in batch.columns else F.lit(None).cast("string")).alias("snapshot_path"))

    def send(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in part:
            for name, own in pdf.groupby("channel", sort=False, dropna=False):
                try:
                    said = channels[name](own.to_dict("records")) if name in channels else [(False, "not configured")] * len(own)
                except Exception as e:  # noqa: BLE001
                    said = [(False, f"{type(e).__name__}: {e}")] * len(own)
                yield pd.DataFrame({"event_id": own["event_id"].to_numpy(), "channel": own["channel"].to_numpy(), "success": [s for s, _ in said], "error": [e for _, e in said]})

    return rows.mapInPandas(send, RECORD)


def deliver(channels: dict[str, Channel], path: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that sends an outbox and writes the records below ``path``, by batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            before = spark.read.schema(f"{RECORD}, sent_at timestamp, batch_id long").parquet(path)
        except AnalysisException:
            before = None
        if before is not None:
            if not before.where(F.col("batch_id") == batch_id).isEmpty():
                return
            reached = before.where("success").select("event_id", "channel").distinct()
            batch = batch.join(reached, ["event_id", "channel"], "left_anti")
        records = sent(batch, channels).withColumn("sent_at", F.current_timestamp())
        records.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return run


def with_notifications(events: DataFrame, records: DataFrame) -> DataFrame:
    """The events with the records of their deliveries added to ``notifications``, to be written to the log again."""
    entry = F.struct("channel", F.unix_micros("sent_at").cast("double").alias("us"), "success", "error")
    per = records.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("new"))  # one per channel and attempt
    new = F.transform("new", lambda r: F.struct(r["channel"].alias("channel"), (r["us"] / 1e6).alias("sent_at"), r["success"].alias("success"), r["error"].alias("error")))
    both = F.concat(F.coalesce("notifications", F.array().cast(events.schema["notifications"].dataType)), new)
    return events.join(per, "event_id").withColumn("notifications", both).drop("new")


def drain(query: StreamingQuery, timeout_s: float = 5.0) -> bool:
    """Wait until a query has nothing left to read; whether it got there in time."""
    end = time.monotonic() + timeout_s
    while time.monotonic() < end:
        progress: Any = query.lastProgress
        if not query.isActive or (progress is not None and progress["numInputRows"] == 0 and not query.status["isTriggerActive"]):
            return True
        time.sleep(0.02)
    return False
