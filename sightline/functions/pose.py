"""Column functions on body keypoints: arrays of x, y, confidence in the order of 17 body parts. y grows downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places of body parts in the array.
NOSE, LEFT_SHOULDER, RIGHT_SHOULDER = 0, 5, 6
LEFT_WRIST, RIGHT_WRIST, LEFT_HIP, RIGHT_HIP, LEFT_ANKLE, RIGHT_ANKLE = 9, 10, 11, 12, 15, 16
PARTS = 17
MIN_CONFIDENCE = 0.3


def _part(k: Column, i: int, least: float) -> Column:
    """The part if it is sure enough, else NULL."""
    p = F.get(k, i)
    return F.when(p["confidence"] > least, p)


def middle(k: Column, a: int, b: int, axis: str, least: float = MIN_CONFIDENCE) -> Column:
    """The mean place of the sure ones of two parts on an axis; NULL if neither is."""
    p, q = _part(k, a, least)[axis], _part(k, b, least)[axis]
    return F.when(p.isNotNull() & q.isNotNull(), (p + q) / F.lit(2.0)).otherwise(F.coalesce(p, q))


def lying(k: Column, least: float = MIN_CONFIDENCE) -> Column:
    """Whether shoulders and hips lie further apart sideways than in height; False if unknown."""
    dx = F.abs(middle(k, LEFT_SHOULDER, RIGHT_SHOULDER, "x", least) - middle(k, LEFT_HIP, RIGHT_HIP, "x", least))
    dy = F.abs(middle(k, LEFT_SHOULDER, RIGHT_SHOULDER, "y", least) - middle(k, LEFT_HIP, RIGHT_HIP, "y", least))
    return F.coalesce(dx > dy, F.lit(False))


def hands_up(k: Column, least: float = MIN_CONFIDENCE) -> Column:
    nose = _part(k, NOSE, least)["y"]
    return F.coalesce(_part(k, LEFT_WRIST, least)["y"] < nose, F.lit(False)) | F.coalesce(_part(k, RIGHT_WRIST, least)["y"] < nose, F.lit(False))


def feet_up(k: Column, least: float = MIN_CONFIDENCE) -> Column:
    hips = middle(k, LEFT_HIP, RIGHT_HIP, "y", least)
    return F.coalesce(_part(k, LEFT_ANKLE, least)["y"] < hips, F.lit(False)) | F.coalesce(_part(k, RIGHT_ANKLE, least)["y"] < hips, F.lit(False))


def pose_class(k: Column, least: float = MIN_CONFIDENCE) -> Column:
    """NORMAL (too few parts), LYING, DANGER (hands and feet up), WARNING (either) or SAFE."""
    hands, feet = hands_up(k, least), feet_up(k, least)
    return (
        F.when(k.isNull() | (F.size(k) < PARTS), "NORMAL").when(lying(k, least), "LYING").when(hands & feet, "DANGER").when(hands | feet, "WARNING").otherwise("SAFE")
    )


def early_pose_class(k: Column, least: float = MIN_CONFIDENCE) -> Column:
    """The first form of the rule: no lying test, hips as plain mean of both, a nose at 0 taken as missing."""
    nose = F.get(k, NOSE)["y"]
    hips = (F.get(k, LEFT_HIP)["y"] + F.get(k, RIGHT_HIP)["y"]) / F.lit(2.0)
    sure = lambda i: F.get(k, i)["confidence"] > least
    hands = (nose > 0) & sure(NOSE) & (((F.get(k, LEFT_WRIST)["y"] < nose) & sure(LEFT_WRIST)) | ((F.get(k, RIGHT_WRIST)["y"] < nose) & sure(RIGHT_WRIST)))
    feet = ((F.get(k, LEFT_ANKLE)["y"] < hips) & sure(LEFT_ANKLE)) | ((F.get(k, RIGHT_ANKLE)["y"] < hips) & sure(RIGHT_ANKLE))
    return F.when(k.isNull() | (F.size(k) < PARTS), "NORMAL").when(hands & feet, "DANGER").when(hands | feet, "WARNING").otherwise("SAFE")


def high_in_frame(b: Column, k: Column, frame_height: Column, box_part: float = 0.6, point_part: float = 0.65) -> Column:
    """Whether a person is up high: the box's top, or the highest keypoint, above a part of the frame height."""
    top = F.array_min(F.transform(F.filter(k, lambda p: p["y"].isNotNull()), lambda p: p["y"]))
    return F.coalesce(b["y1"] < frame_height * box_part, F.lit(False)) | F.coalesce(top < frame_height * point_part, F.lit(False))


def high_by_points(b: Column, k: Column, frame_height: Column, least_part: float = 0.68, mean_part: float = 0.70, box_part: float = 0.60) -> Column:
    """The later form: by the highest or the mean keypoint; by the box's top where there are no keypoints."""
    ys = F.transform(k, lambda p: p["y"])
    mean = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / F.when(F.size(k) > 0, F.size(k))
    points = (F.array_min(ys) < frame_height * least_part) | (mean < frame_height * mean_part)
    return F.coalesce(F.when(k.isNotNull() & (F.size(k) > 0), points).otherwise(b["y1"] < frame_height * box_part), F.lit(False))
