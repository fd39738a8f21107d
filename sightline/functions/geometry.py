"""Column functions on boxes (structs with x1, y1, x2, y2), points and polygons. NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Part of the frame height at the top and bottom edge within which a box counts as cut off.
EDGE_MARGIN = 0.01


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    """The area; a side below 0 counts as 0."""
    zero = F.lit(0.0)
    return F.when(b.isNotNull(), F.greatest(zero, width(b)) * F.greatest(zero, height(b)))


def int_box(b: Column) -> Column:
    """The box with coordinates cut to whole pixels, toward zero."""
    return F.when(b.isNotNull(), F.struct(*(b[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))))


def overlap_area(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = overlap_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(F.lit(0.0))


def gap(a: Column, b: Column) -> Column:
    """The distance between two boxes; 0 where they touch or overlap."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    dy = F.greatest(zero, F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    return F.sqrt(dx * dx + dy * dy)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes share area; touching edges don't count."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def near(x: Column, y: Column, b: Column, margin: float) -> Column:
    """Whether a point lies in the box widened by a part of its size on every side, edges included."""
    mx, my = width(b) * margin, height(b) * margin
    return x.between(b["x1"] - mx, b["x2"] + mx) & y.between(b["y1"] - my, b["y2"] + my)


def mirror(b: Column, frame_width: Column) -> Column:
    """The box in the frame mirrored left to right."""
    return F.when(b.isNotNull(), F.struct((frame_width - b["x2"]).alias("x1"), b["y1"].alias("y1"), (frame_width - b["x1"]).alias("x2"), b["y2"].alias("y2")))


def scale(b: Column, sx: Column, sy: Column) -> Column:
    """The box in a resized frame."""
    return F.when(b.isNotNull(), F.struct((b["x1"] * sx).alias("x1"), (b["y1"] * sy).alias("y1"), (b["x2"] * sx).alias("x2"), (b["y2"] * sy).alias("y2")))


def foot(b: Column, frame_width: Column, frame_height: Column) -> tuple[Column, Column]:
    """The middle of the lower edge as parts of the frame."""
    return (b["x1"] + b["x2"]) / F.lit(2.0) / frame_width, b["y2"] / frame_height


def cut_below(b: Column, frame_height: Column) -> Column:
    return b["y2"] >= F.lit(1 - EDGE_MARGIN) * frame_height


def cut_above(b: Column, frame_height: Column) -> Column:
    return b["y1"] <= F.lit(EDGE_MARGIN) * frame_height


def in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies in a polygon (array of x, y), by the even-odd rule; the polygon may be concave."""

    def crosses(i: Column) -> Column:
        p, q = polygon[i], polygon[(i + F.size(polygon) - 1) % F.size(polygon)]
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(spans, q["y"] - p["y"]) + p["x"]
        return spans & (x < at)

    count = F.aggregate(F.sequence(F.lit(0), F.size(polygon) - 1), F.lit(0), lambda n, i: n + F.when(crosses(i), 1).otherwise(0))
    return count % 2 == 1


def in_bounds(x: Column, y: Column, polygon: Column) -> Column:
    """The cheap test before :func:`in_polygon`: whether a point lies in the box around the polygon."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return x.between(F.array_min(xs), F.array_max(xs)) & y.between(F.array_min(ys), F.array_max(ys))


def expected_height(foot_y: Column, c: Column) -> Column:
    """The height of a standing adult by the foot's place, between the near and the far measurement of ``c``.

    Linear between the two; held from half the measured span beyond them; at least 0.02. With both at one place, the mean.
    """
    dy = c["near_foot_y"] - c["far_foot_y"]
    flat = F.abs(dy) < 1e-6
    slope = (c["near_height"] - c["far_height"]) / F.when(~flat, dy)
    low, high = F.least(c["near_foot_y"], c["far_foot_y"]), F.greatest(c["near_foot_y"], c["far_foot_y"])
    margin = (high - low) * 0.5
    at = F.least(F.greatest(foot_y, low - margin), high + margin)
    mean = (c["near_height"] + c["far_height"]) / 2
    return F.when(c.isNotNull(), F.greatest(F.lit(0.02), F.when(flat, mean).otherwise(c["far_height"] + slope * (at - c["far_foot_y"]))))


def height_ratio(b: Column, frame_height: Column, calibration: Column) -> Column:
    """A person's height against that of an adult at the same place; NULL if it can't be measured."""
    seen = calibration.isNotNull() & ~cut_above(b, frame_height) & ~cut_below(b, frame_height)
    return F.when(seen, height(b) / frame_height / expected_height(b["y2"] / frame_height, calibration))


def active_at(seconds: Column, ranges: Column) -> Column:
    """Whether a time of day lies in one of the ranges of minutes [start, end), which may pass midnight; none: always."""
    minute = F.floor((seconds - F.floor(seconds / 86400) * 86400) / 60)
    inside = F.exists(
        ranges,
        lambda r: F.when(r["start_min"] <= r["end_min"], (minute >= r["start_min"]) & (minute < r["end_min"])).otherwise((minute >= r["start_min"]) | (minute < r["end_min"])),
    )
    return (F.coalesce(F.size(ranges), F.lit(0)) <= 0) | inside
