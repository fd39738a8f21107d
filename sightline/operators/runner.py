"""Detectors and policies as Python objects, run over frames where the frames are, each module by itself.

A detector is loaded once per task and closed with it. A module that fails on a frame leaves an error there, and nothing
else: other modules, other frames and later frames of the same module go on. Labels and least confidence are arguments of
the model call, so that a model that can filter does so itself.

Defined results: a module whose detector can't be loaded has an error on each frame it should run on; a NULL frame number
runs every module; no modules give no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Frame = dict[str, Any]


class Detector:
    """What finds things in frames. ``every``: it runs on each such frame number."""

    name = "detector"
    every = 1

    def load(self) -> None:
        """Get ready; runs once per task."""

    def process(self, frame: Frame) -> list[dict]:
        """The detections of a frame: label, confidence and, if known, bbox (x1, y1, x2, y2) and attributes."""
        raise TypeError(f"{type(self).__name__} doesn't say how to process a frame")

    def close(self) -> None:
        """Let go of what load took."""

    def should_run(self, number: int | None) -> bool:
        return number is None or self.every <= 1 or number % self.every == 0


@dataclass
class LabelDetector(Detector):
    """A detector around a model call ``predict(frame, labels, least)``; what the model lets through is filtered again."""

    predict: Callable[[Frame, Sequence[str], float], list[dict]]
    labels: Sequence[str] = ()
    least: float = 0.0
    name: str = "labels"
    every: int = 1
    opened: Callable[[], None] | None = None

    def load(self) -> None:
        if self.opened:
            self.opened()

    def process(self, frame: Frame) -> list[dict]:
        wanted = {x.lower() for x in self.labels}
        found = self.predict(frame, self.labels, self.least)
        return [d for d in found if (not wanted or (d["label"] or "").lower() in wanted) and (d["confidence"] or 0.0) >= self.least]


@dataclass
class PoseDetector(LabelDetector):
    """A detector of people with keypoints; ``status`` names the pose from them."""

    status: Callable[[list], str] = lambda points: "NORMAL"
    name: str = "pose"

    def process(self, frame: Frame) -> list[dict]:
        return [{**d, "attributes": {**(d.get("attributes") or {}), "pose_status": self.status(d.get("keypoints") or [])}} for d in super().process(frame)]


Policy = Callable[[Frame, list[dict]], list[dict]]


@dataclass
class Module:
    """A detector and what makes candidates (event_type, confidence, subject) of its detections."""

    detector: Detector
    policy: Policy = field(default=lambda frame, found: [])
    name: str = ""

    def __post_init__(self) -> None:
        self.name = self.name or self.detector.name


_DETECTION = "struct<label:string,confidence:double,bbox:struct<x1:double,y1:double,x2:double,y2:double>,attributes:map<string,string>>"
_CANDIDATE = "struct<event_type:string,confidence:double,subject:string>"


def _struct(d: dict, names: Sequence[str]) -> dict:
    return {n: d.get(n) for n in names}


def run_modules(frames: DataFrame, modules: Sequence[Module], camera: str = "camera_id", number: str = "frame_index") -> DataFrame:
    """A row for each frame and module that runs on it: camera, number, module, detections, candidates, error."""
    schema = T.StructType([frames.schema[camera], frames.schema[number], *T._parse_datatype_string(f"module string, detections array<{_DETECTION}>, candidates array<{_CANDIDATE}>, error string").fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken: dict[str, str] = {}
        for m in modules:
            try:
                m.detector.load()
            except Exception as e:  # noqa: BLE001
                broken[m.name] = f"{type(e).__name__}: {e}"
        try:
            for pdf in parts:
                out = []
                for frame in pdf.to_dict("records"):
                    at = None if pd.isna(frame[number]) else int(frame[number])
                    for m in (m for m in modules if m.detector.should_run(at)):
                        found, made, error = [], [], broken.get(m.name)
                        if error is None:
                            try:
                                found = m.detector.process(frame)
                                made = m.policy(frame, found)
                            except Exception as e:  # noqa: BLE001
                                found, made, error = [], [], f"{type(e).__name__}: {e}"
                        out.append((frame[camera], at, m.name, [_struct(d, ("label", "confidence", "bbox", "attributes")) for d in found], [_struct(c, ("event_type", "confidence", "subject")) for c in made], error))
                yield pd.DataFrame(out, columns=schema.names)
        finally:
            for m in modules:
                try:
                    m.detector.close()
                except Exception:  # noqa: BLE001, S110
                    pass

    return frames.mapInPandas(run, schema)


def module_counts(ran: DataFrame) -> DataFrame:
    """Per module: frames it ran on, those with an error, and candidates."""
    return ran.groupBy("module").agg(F.count("*").alias("frames"), F.count("error").alias("errors"), F.sum(F.size("candidates")).alias("candidates"))
