"""Class-wise suppression of overlapping boxes within a frame, as a fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geometry import iou


def suppress(df: DataFrame, frame: list[str], label: Column, det_id: str, confidence: str, box: str, threshold: float) -> DataFrame:
    """The ids kept: by falling confidence (ties: smaller id), unless a kept box of the label overlaps by more than ``threshold``.

    Groups are the boxes of one frame and label, which a frame bounds. Rows without box, label or confidence are left out.
    """
    rows = df.select(*frame, label.alias("__label"), F.col(det_id).alias("id"), F.col(confidence).alias("c"), F.col(box).alias("b"))
    rows = rows.where("__label IS NOT NULL AND c IS NOT NULL AND b IS NOT NULL")
    ranked = rows.groupBy(*frame, "__label").agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "id", "b"))).alias("boxes"))
    kind = ranked.schema["boxes"].dataType.simpleString()
    kept = F.aggregate("boxes", F.expr(f"CAST(array() AS {kind})"), lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["b"], x["b"]) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return ranked.select(F.explode(kept).alias("k"), "__label", *frame).select(F.col("k.id").alias(det_id), *frame, F.col("__label").alias("label_key"))
