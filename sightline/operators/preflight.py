"""Checks of a set-up before a run, as rows: name, status (OK, WARN or FAIL) and detail. A check that breaks has failed."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Check = Callable[[], tuple[str, str]]


def weights_present(path: str) -> Check:
    return lambda: ("OK", path) if Path(path).is_file() else ("FAIL", f"missing: {path}")


def zones_calibrated(zones: list[dict[str, Any]]) -> Check:
    """Zones that look for children need a calibration; no zones at all are worth a warning."""
    open_ = [z["name"] for z in zones if z.get("child_filter", True) and not z.get("calibration")]
    return lambda: ("WARN", "no zones") if not zones else ("WARN", f"not calibrated: {', '.join(open_)}") if open_ else ("OK", f"{len(zones)} zones")


def credentials_present(values: dict[str, str | None]) -> Check:
    missing = sorted(k for k, v in values.items() if not v)
    return lambda: ("WARN", f"missing: {', '.join(missing)}") if missing else ("OK", f"{len(values)} set")


def storage_writable(folder: str, least_free: int = 1_000_000_000) -> Check:
    def check() -> tuple[str, str]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        probe = Path(folder) / f".probe-{os.getpid()}"
        probe.write_bytes(b"x")
        probe.unlink()
        free = shutil.disk_usage(folder).free
        return ("OK" if free >= least_free else "WARN"), f"{free // 1_000_000} MB free"

    return check


def source_opens(frames: Callable[[], Any]) -> Check:
    """``frames()`` iterates over the source's frames; one is enough."""
    return lambda: ("OK", "first frame read") if next(iter(frames()), None) is not None else ("FAIL", "no frame")


def model_runs(process: Callable[[dict], list], frame: dict | None = None) -> Check:
    return lambda: ("OK", f"{len(process(frame or {}))} detections")


def run_checks(spark: SparkSession, checks: dict[str, Check]) -> DataFrame:
    """The checks in order as rows."""
    rows = []
    for k, (name, check) in enumerate(checks.items()):
        try:
            status, detail = check()
        except Exception as e:  # noqa: BLE001
            status, detail = "FAIL", f"{type(e).__name__}: {e}"
        rows.append((k, name, status, detail))
    return spark.createDataFrame(rows, "at int, name string, status string, detail string")


def any_failed(rows: DataFrame) -> DataFrame:
    """One row: whether any check failed, as an exit code."""
    return rows.agg(F.coalesce(F.max((F.col("status") == "FAIL").cast("int")), F.lit(0)).alias("exit_code"))
