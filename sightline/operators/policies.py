"""Rules that turn the detections of a frame into candidates of events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions.text import hundredths
from sightline.functions.pose import MIN_CONFIDENCE, pose_class

FRAME = ["camera_id", "frame_index"]


@dataclass(frozen=True)
class LabelRule:
    """Detections with one of the labels and at least the confidence speak for an event type."""

    event_type: str
    labels: tuple[str, ...]
    min_confidence: float = 0.0

    def __post_init__(self) -> None:
        if not self.labels:
            raise ValueError("a label rule needs labels")


def rule_table(df: DataFrame, rules: list[LabelRule]) -> DataFrame:
    """The rules as rows (label_key, event_type, min_confidence); as many as the configuration names."""
    rows = [(label.lower(), r.event_type, float(r.min_confidence)) for r in rules for label in sorted(set(r.labels))]
    return df.sparkSession.createDataFrame(rows, "label_key string, event_type string, min_confidence double")


def label_match(df: DataFrame, rules: list[LabelRule]) -> DataFrame:
    """Per frame, detector and event type the surest matching detection (ties: the first) and how many match."""
    hits = df.withColumn("label_key", F.lower("label")).join(F.broadcast(rule_table(df, rules)), "label_key").where("confidence >= min_confidence")
    best = F.max(F.struct("confidence", (-F.col("det_idx")).alias("o"), "det_id", "label", "ts")).alias("r")
    return hits.groupBy(*FRAME, "detector", "event_type").agg(best, F.count("*").alias("match_count")).select(*FRAME, "detector", "event_type", "match_count", "r.confidence", "r.det_id", "r.label", "r.ts")


def every_nth(df: DataFrame, n: int) -> DataFrame:
    """The detections of each n-th frame."""
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.where(F.col("frame_index") % n == 0)


def drop_overlapped(df: DataFrame, labels: list[str], others: list[str]) -> DataFrame:
    """Leave out detections of ``labels`` that overlap one of ``others`` of an earlier module on the same frame."""
    blocked = df.where(F.lower("label").isin([x.lower() for x in others])).select(*(F.col(c).alias(f"o_{c}") for c in FRAME), F.col("module_order").alias("o_order"), F.col("bbox").alias("o_box"))
    same = [F.col(c) == F.col(f"o_{c}") for c in FRAME]
    clash = (F.col("o_order") < F.col("module_order")) & G.overlaps(F.col("bbox"), F.col("o_box")) & F.lower("label").isin([x.lower() for x in labels])
    return df.join(blocked, [*same, clash], "left_anti")


def in_zones(df: DataFrame, zones: DataFrame, person: str = "person", min_confidence: float = 0.4, child_ratio: float = 0.75) -> DataFrame:
    """Each person whose foot is in an active zone of its camera, with the ratio of heights and the limit for children.

    ``zones``: camera_id, zone, polygon, active, child_filter, child_ratio, calibration; a configuration, joined on the camera.
    """
    people = df.where((F.lower("label") == person.lower()) & (F.col("confidence") >= min_confidence) & (F.col("frame_width") > 0) & (F.col("frame_height") > 0) & F.col("bbox").isNotNull())
    people = people.where(~G.cut_below(F.col("bbox"), F.col("frame_height")))
    x, y = G.foot(F.col("bbox"), F.col("frame_width"), F.col("frame_height"))
    hits = people.withColumns({"foot_x": x, "foot_y": y}).join(zones, "camera_id")
    hits = hits.where(G.active_at(F.col("ts"), F.col("active")) & G.in_bounds(F.col("foot_x"), F.col("foot_y"), F.col("polygon")) & G.in_polygon(F.col("foot_x"), F.col("foot_y"), F.col("polygon")))
    return hits.withColumns({"height_ratio": F.when(F.col("child_filter"), G.height_ratio(F.col("bbox"), F.col("frame_height"), F.col("calibration"))), "limit": F.coalesce("child_ratio", F.lit(child_ratio))})


def zone_hits(df: DataFrame, zones: DataFrame, person: str = "person", min_confidence: float = 0.4, child_ratio: float = 0.75) -> DataFrame:
    """Those of :func:`in_zones` that are small enough, where the zone asks for it."""
    return in_zones(df, zones, person, min_confidence, child_ratio).where(~F.col("child_filter") | (F.col("height_ratio") < F.col("limit"))).drop("limit")


def zone_tags(df: DataFrame, zones: DataFrame, child_ratio: float = 0.75) -> DataFrame:
    """What is written beside each measured person in a zone for children: CHILD or adult, and the ratio of heights."""
    hits = in_zones(df, zones, child_ratio=child_ratio).where("child_filter AND height_ratio IS NOT NULL")
    return hits.withColumn("tag", F.concat(F.when(F.col("height_ratio") < F.col("limit"), "CHILD ").otherwise("adult "), hundredths(F.col("height_ratio"))))


def out_of_area(hits: DataFrame) -> DataFrame:
    """Per frame, detector and zone the surest person in it (ties: the first) and how many there are."""
    best = F.max(F.struct("confidence", (-F.col("det_idx")).alias("o"), "det_id", "height_ratio", "ts")).alias("r")
    return hits.groupBy(*FRAME, "detector", "zone").agg(best, F.count("*").alias("people_in_zone")).select(*FRAME, "detector", "zone", "people_in_zone", "r.confidence", "r.det_id", "r.height_ratio", "r.ts")


def climbing(df: DataFrame, require_both: bool = True, keypoint_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per frame and detector the surest climber (ties: the first) and the number of people at risk."""
    posed = df.where("keypoints IS NOT NULL AND size(keypoints) > 0").withColumn("pose", pose_class(F.col("keypoints"), keypoint_confidence))
    risky = posed.where(F.col("pose").isin(["DANGER"] if require_both else ["DANGER", "WARNING"]))
    best = F.max(F.struct("confidence", (-F.col("det_idx")).alias("o"), "det_id", "pose", "ts")).alias("r")
    return risky.groupBy(*FRAME, "detector").agg(best, F.count("*").alias("people_at_risk")).select(*FRAME, "detector", "people_at_risk", "r.confidence", "r.det_id", "r.pose", "r.ts")
