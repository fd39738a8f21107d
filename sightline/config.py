"""Configuration: YAML or JSON files, event rules per type, zones, routes, modules and plug-ins by name."""

from __future__ import annotations

import copy
import importlib
import json
import re
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sightline.operators.lifecycle import EventRule
from sightline.operators.report import Route

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None


def load_config(path: str | Path) -> dict[str, Any]:
    """A configuration file; a missing one is an error, an empty one an empty configuration."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"no configuration at {p}")
    text = p.read_text(encoding="utf-8")
    if p.suffix.lower() == ".json":
        return json.loads(text) if text.strip() else {}
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package; use JSON")
    return yaml.safe_load(text) or {}


def parse_hours(text: str) -> tuple[int, int]:
    """'HH:MM-HH:MM' as minutes of the day; a range may pass midnight."""
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{1,2})\s*-\s*(\d{1,2}):(\d{1,2})\s*", text)
    if not m:
        raise ValueError(f"bad time range {text!r}, expected HH:MM-HH:MM")
    a, b, c, d = map(int, m.groups())
    if not (a <= 23 and c <= 23 and b <= 59 and d <= 59):
        raise ValueError(f"bad time in {text!r}")
    return a * 60 + b, c * 60 + d


def event_rules(config: dict[str, Any]) -> tuple[EventRule, dict[str, EventRule]]:
    """The default rule and those of single types, which inherit what they don't name."""
    known = {f.name for f in fields(EventRule)}
    pick = lambda d: {k: (int if k == "confirm_hits" else float)(v) for k, v in (d or {}).items() if k in known}
    base = pick(config.get("default"))
    return EventRule(**base), {t: EventRule(**{**base, **pick(d)}) for t, d in (config.get("types") or {}).items()}


def routes(config: dict[str, Any]) -> tuple[list[Route], list[str]]:
    """The routes and the channels that are switched on (console unless it says no, others only if they say yes)."""
    channels = config.get("channels") or {}
    enabled = [c for c in {"console": {}, **channels} if (channels.get(c) or {}).get("enabled", c == "console")]
    return [Route.parse(r) for r in config.get("routes") or []], enabled


ZONE_SCHEMA = "camera_id string, zone string, polygon array<struct<x:double,y:double>>, active array<struct<start_min:int,end_min:int>>, child_filter boolean, child_ratio double, calibration struct<near_foot_y:double,near_height:double,far_foot_y:double,far_height:double>"


def zone_row(camera_id: str, z: dict[str, Any]) -> tuple:
    """A zone of a configuration as a row; it needs three points or more, all within 0..1."""
    polygon = [(float(x), float(y)) for x, y in z["polygon"]]
    if len(polygon) < 3:
        raise ValueError(f"zone {z['name']!r} needs at least 3 points")
    if not all(0 <= v <= 1 for p in polygon for v in p):
        raise ValueError(f"zone {z['name']!r}: points must lie in 0..1")
    c = z.get("calibration")
    cal = (float(c["near"]["foot_y"]), float(c["near"]["height"]), float(c["far"]["foot_y"]), float(c["far"]["height"])) if c else None
    ratio = z.get("child_ratio")
    return (str(camera_id), str(z["name"]), polygon, [parse_hours(h) for h in z.get("active_hours") or []], bool(z.get("child_filter", True)), None if ratio is None else float(ratio), cal)


def zones(spark: SparkSession, config: dict[str, list[dict[str, Any]]] | None) -> DataFrame:
    """The zones of all cameras; no configuration gives an empty table."""
    return spark.createDataFrame([zone_row(c, z) for c, zs in (config or {}).items() for z in zs or []], ZONE_SCHEMA)


def load_zones(spark: SparkSession, path: str | Path) -> DataFrame:
    """The zones of a file; a missing file has none."""
    return zones(spark, (load_config(path).get("cameras") or {}) if Path(path).is_file() else {})


def save_zone(path: str | Path, camera_id: str, zone: dict[str, Any]) -> None:
    """Put a zone into a JSON file, in place of one of the same camera and name; coordinates to four places."""
    zone_row(camera_id, zone)
    p = Path(path)
    data = load_config(p) if p.is_file() else {}
    cameras = data.setdefault("cameras", {})
    rounded = json.loads(json.dumps(zone), parse_float=lambda s: round(float(s), 4))
    cameras[camera_id] = [z for z in cameras.get(camera_id, []) if z["name"] != zone["name"]] + [rounded]
    p.write_text(json.dumps(data, ensure_ascii=False, indent=1), encoding="utf-8")


def calibration_point(head: tuple[float, float], feet: tuple[float, float], height: float) -> tuple[float, float]:
    """Foot place and body height of a person clicked at head and feet, in either order, as parts of the frame."""
    low, high = max(head[1], feet[1]), min(head[1], feet[1])
    if low <= high:
        raise ValueError("head and feet lie at the same height")
    return low / height, (low - high) / height


def check_calibration(near: tuple[float, float], far: tuple[float, float]) -> dict[str, dict[str, float]]:
    """Two measurements as a calibration: the near one lies lower, five hundredths or more away, and is taller."""
    if near[0] <= far[0]:
        raise ValueError("the near measurement must lie below the far one")
    if near[0] - far[0] < 0.05:
        raise ValueError("the measurements lie too close to each other")
    if near[1] <= far[1]:
        raise ValueError("the near measurement must be taller")
    return {"near": {"foot_y": near[0], "height": near[1]}, "far": {"foot_y": far[0], "height": far[1]}}


def snap(value: float, edge: float = 0.02) -> float:
    """A part of the frame, set to the edge if it lies within ``edge`` of it, to four places."""
    v = min(max(value, 0.0), 1.0)
    return 0.0 if v <= edge else 1.0 if v >= 1 - edge else round(v, 4)


def clamp(value: float, low: float, high: float) -> float:
    return round(min(max(value, low), high), 2)


def build(spec: dict[str, Any] | str, base: type | None = None) -> Any:
    """The object that 'module:Name' and its parameters describe; it must be of the base class, if one is given."""
    path, params = (spec, {}) if isinstance(spec, str) else (spec["class"], spec.get("params") or {})
    module, _, name = path.partition(":")
    if not name:
        raise ValueError(f"expected module:Name, got {path!r}")
    kind = getattr(importlib.import_module(module), name)
    if base is not None and not (isinstance(kind, type) and issubclass(kind, base)):
        raise TypeError(f"{path} is not a {base.__name__}")
    return kind(**params) if params or isinstance(kind, type) else kind


def selected(modules: list[dict[str, Any]], only: list[str] | None = None) -> list[dict[str, Any]]:
    """The modules that are switched on; with names given, exactly those, on or not."""
    if only is None:
        return [m for m in modules if m.get("enabled", True)]
    missing = set(only) - {m["name"] for m in modules}
    if missing:
        raise ValueError(f"no such modules: {sorted(missing)}")
    return [m for m in modules if m["name"] in only]


def class_ids(names: dict[int, str], wanted: list[str]) -> list[int]:
    """The numbers of the wanted classes, whatever their case; a missing one is an error."""
    by = {v.lower(): k for k, v in names.items()}
    missing = [w for w in wanted if w.lower() not in by]
    if missing:
        raise ValueError(f"the model has no class {missing}")
    return [by[w.lower()] for w in wanted]


def for_evaluation(config: dict[str, Any]) -> dict[str, Any]:
    """A copy of a configuration with every channel off, so that a run for evaluation sends nothing."""
    out = copy.deepcopy(config)
    names = {"console", *(out.get("channels") or {})}
    out["channels"] = {n: {**((out.get("channels") or {}).get(n) or {}), "enabled": False} for n in sorted(names)}
    return out


Policy = Callable[[DataFrame], DataFrame]


def run_policies(detections: DataFrame, policies: dict[str, Policy]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Each policy's candidates, and the errors of those that can't be planned. They share the detections' scan; nothing
    runs until a result is asked for. What may fail on single frames belongs into operators.runner."""
    made, errors = {}, {}
    for name, policy in policies.items():
        try:
            made[name] = policy(detections)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {e}"
    return made, errors
