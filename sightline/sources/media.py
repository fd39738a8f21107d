"""Descriptions of frame sources and readers of files that come with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of pictures.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def source_kind(source: Column) -> Column:
    """What a source is by its name: all digits a webcam, with '://' a stream, a picture's suffix an image, else a video."""
    return (
        F.when(source.isNull(), F.lit(None).cast("string"))
        .when(source.rlike("^[0-9]+$"), "webcam")
        .when(source.contains("://"), "stream")
        .when(F.lower(source).rlike(rf"\.({'|'.join(IMAGE_SUFFIXES)})$"), "image")
        .otherwise("video")
    )


def images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The files of a folder and all below it: path, name, content and its SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content", F.sha2("content", 256).alias("sha256"))


def with_backup(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """The primary frames; if there are none, those of the backup. ``is_backup`` tells which."""
    first = primary.withColumn("is_backup", F.lit(False))
    return first if not primary.isEmpty() else backup.withColumn("is_backup", F.lit(True))


def looped(frames: DataFrame, times: int, length: int) -> DataFrame:
    """The frames repeated ``times`` times, with frame numbers going on by ``length`` each time."""
    again = frames.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return again.withColumn("frame_index", F.col("frame_index") + F.col("__turn") * length).drop("__turn")


def verified(files: DataFrame, expected: str) -> DataFrame:
    """The files of :func:`images`, failing at run time on one whose SHA-256 isn't the expected one."""
    if not expected:
        raise ValueError("the expected hash must be given")
    wrong = F.raise_error(F.concat(F.lit("hash differs: "), F.col("path"))).cast("boolean")
    return files.where(F.when(F.col("sha256") != expected.lower(), wrong).otherwise(F.lit(True)))
