"""The event log as Parquet by day: upserts, lookups, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.dedupe import latest_version


def with_json(events: DataFrame) -> DataFrame:
    """The events with the whole event as JSON beside its columns."""
    return events.withColumn("data_json", F.to_json(F.struct(*events.columns)))


def append(events: DataFrame, path: str) -> None:
    """Write versions of events, by the day they began; readers take the last version of each id."""
    day = F.date_from_unix_date(F.floor(F.col("started_at") / 86400).cast("int"))
    events.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each event by its last version."""
    return latest_version(spark.read.parquet(path), ["event_id"], "version")


def get(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """One event; the predicate is pushed into the scan."""
    return latest_version(spark.read.parquet(path).where(F.col("event_id") == event_id), ["event_id"], "version")


def latest(spark: SparkSession, path: str, limit: int = 100, event_type: str | None = None) -> DataFrame:
    """The events that began last, of one type if given."""
    log = read(spark, path)
    log = log if event_type is None else log.where(F.col("event_type") == event_type)
    return log.orderBy(F.desc("started_at"), "event_id").limit(limit)
