"""Writers of reports and data sets: files of a known, small number of rows, and folders of pictures."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import hundredths, moment, one_decimal

MOST_ROWS = 100_000


def _rows(df: DataFrame, most: int) -> list[Any]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it as CSV")
    return rows


def _base(path: Any) -> Any:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def _pairs(counts: str) -> Any:
    """A map as 'key:number' parts in order of the keys, or 'none'."""
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(F.col(counts))), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    return F.coalesce(F.when(joined != "", joined), F.lit("none"))


def clip_rows(clips: DataFrame) -> DataFrame:
    """A row per clip as a report shows it: file name, split, expected and fired types, seconds, frames."""
    expected = F.array_join(F.array_sort("expected"), ";")
    return clips.select(_base(F.col("path")).alias("clip"), "split", F.coalesce(F.when(expected != "", expected), F.lit("none")).alias("expected"), _pairs("fired").alias("fired"), one_decimal(F.col("duration_s")).alias("duration_s"), "frames")


def write_clip_report(clips: DataFrame, scores: DataFrame, gates: DataFrame, folder: str, tag: str, notes: list[str] | None = None) -> tuple[str, str]:
    """The clips as CSV files below ``folder``/tag_clips and a Markdown summary with scores and gates.

    ``scores``: operators.evaluate.clip_scores; ``gates``: gate_status. Both are as long as the configuration.
    """
    target, summary = f"{folder.rstrip('/')}/{tag}_clips", Path(folder) / f"{tag}_summary.md"
    clip_rows(clips).write.mode("errorifexists").option("header", True).csv(target)
    total = clips.agg(F.count("*").alias("n"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("s")).first()
    lines = [f"# Clip evaluation: {tag}", "", *(f"- {n}" for n in notes or []), f"- clips: {total['n']}, video time {total['s'] / 60:.1f} min", ""]
    lines += ["| event type | detected (of positive clips) | false alarm clips (of negative clips) | false alarm events | per hour of negative video |", "|---|---|---|---|---|"]
    lines += [f"| {s['event_type']} | {s['tp']}/{s['tp'] + s['fn']} | {s['fp_clips']}/{s['neg_clips']} | {s['fp_events']} | {s['fp_per_hour'] or 0:.1f} |" for s in _rows(scores.orderBy("event_type"), 1000)]
    lines += ["", "## Gates (test split)", "", "| gate | clips | counted | result |", "|---|---|---|---|"]
    lines += [f"| {g['gate']} | {g['clips']} | {g['counted']} | **{g['status']}** |" for g in _rows(gates, 1000)]
    summary.write_text("\n".join([*lines, ""]), encoding="utf-8")
    return target, str(summary)


def event_rows(log: DataFrame, explained: DataFrame) -> DataFrame:
    """A row per event as a report shows it: the log with what operators.report.explain made of it."""
    both = log.join(explained.select("event_id", "outcome", "reason"), "event_id")
    seen = one_decimal(F.greatest(F.lit(0.0), F.col("last_seen_at") - F.col("started_at")))
    return both.select(
        moment(F.col("started_at"), "yyyy-MM-dd HH:mm:ss").alias("started"), moment(F.col("confirmed_at"), "yyyy-MM-dd HH:mm:ss").alias("confirmed"), "event_type", F.coalesce("subject", F.lit("")).alias("subject"), seen.alias("seconds_seen"), F.col("hit_count").alias("sightings"),
        hundredths(F.col("peak_confidence")).alias("peak"), F.coalesce("peak_label", F.lit("")).alias("peak_label"), "outcome", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(_base(F.col("snapshot_path")), F.lit("")).alias("snapshot"),
    )


def write_event_report(log: DataFrame, explained: DataFrame, funnel: DataFrame, folder: str, title: str, most: int = MOST_ROWS) -> tuple[str, str]:
    """The events as CSV files below ``folder``/events and as Markdown, with the funnel per type (operators.report.funnel)."""
    target, path = f"{folder.rstrip('/')}/events", Path(folder) / "events.md"
    rows = event_rows(log, explained)
    rows.write.mode("errorifexists").option("header", True).csv(target)
    types = _rows(funnel.orderBy("event_type"), 1000)
    lines = [f"# Event log: {title}", "", "| event type | sightings | events | sent | send failed | not sent |", "|---|---|---|---|---|---|"]
    lines += [f"| {t['event_type']} | {t['sightings'] or 0:,} | {t['events']} | {t['sent']} | {t['failed']} | {t['not_sent']} |" for t in types]
    lines += ["", "| started | type | subject | seen (s) | sightings | peak | outcome | snapshot |", "|---|---|---|---|---|---|---|---|"]
    for r in _rows(rows.orderBy("started", "event_type"), most):
        why = f" ({r['reason']})" if r["reason"] else ""
        lines.append(f"| {r['started']} | {r['event_type']} | {r['subject']} | {r['seconds_seen']} | {r['sightings']} | {r['peak']} {r['peak_label']} | {r['outcome']}{why} | {r['snapshot']} |")
    path.write_text("\n".join([*lines, ""]), encoding="utf-8")
    return target, str(path)


def write_image_set(items: DataFrame, folder: str, classes: list[str], info: dict[str, Any] | None = None) -> dict[str, Any]:
    """A data set of pictures and label files by side, with data.yaml and build_info.json.

    ``items``: side (train or val), name, content, lines (array of label lines). ``folder`` must not exist and be one that
    all executors share; each task writes its own pictures there. Gives the report that build_info.json holds.
    """
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=False)
    for side in ("train", "val"):
        for kind in ("images", "labels"):
            (root / side / kind).mkdir(parents=True)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for side, name, content, lines in zip(pdf["side"], pdf["name"], pdf["content"], pdf["lines"]):
                at, own = Path(folder) / side, [] if lines is None else list(lines)
                (at / "images" / name).write_bytes(content)
                (at / "labels" / f"{Path(name).stem}.txt").write_text("".join(f"{x}\n" for x in own), encoding="utf-8")
            yield pd.DataFrame({"side": pdf["side"], "boxes": [0 if x is None else len(x) for x in pdf["lines"]]})

    done = items.select("side", "name", "content", "lines").mapInPandas(write, "side string, boxes long")
    counted = done.groupBy("side").agg(F.count("*").alias("images"), F.count_if(F.col("boxes") > 0).alias("positives"), F.sum("boxes").alias("boxes")).collect()
    report = {r["side"]: {"images": r["images"], "positives": r["positives"], "negatives": r["images"] - r["positives"], "boxes": r["boxes"]} for r in counted}
    names = "".join(f"  {i}: {c}\n" for i, c in enumerate(classes))
    (root / "data.yaml").write_text(f"train: train/images\nval: val/images\nnames:\n{names}", encoding="utf-8")
    (root / "build_info.json").write_text(json.dumps({**(info or {}), "report": report}, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return report


def write_record(path: str, record: dict[str, Any]) -> None:
    """The record of a training run beside its weights, as JSON; an existing one is never overwritten."""
    with Path(path).open("x", encoding="utf-8") as f:
        f.write(json.dumps(record, indent=2, ensure_ascii=False) + "\n")


def write_snapshots(events: DataFrame, folder: str) -> DataFrame:
    """Write each event's picture (name, content) into a shared folder; what couldn't be written has its error."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            errors = []
            for name, content in zip(pdf["name"], pdf["content"]):
                try:
                    at = Path(folder) / name
                    at.parent.mkdir(parents=True, exist_ok=True)
                    at.write_bytes(content)
                    errors.append(None)
                except (OSError, TypeError) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"event_id": pdf["event_id"], "name": pdf["name"], "error": errors})

    return events.select("event_id", "name", "content").mapInPandas(write, "event_id string, name string, error string")
