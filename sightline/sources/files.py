"""Readers and writers of the small files around a data set: labels, reports, thresholds, label trees, archives."""

from __future__ import annotations

import io
import json
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

LABELS_SCHEMA = "path string, split string, expected string, note string"
#: The columns of a results file, in order.
RESULT_COLUMNS = (
    "timestamp", "object", "scenario", "distance_m", "lighting", "background", "detected(y/n)", "confidence", "bbox_w_px", "bbox_h_px", "conf_threshold", "imgsz", "capture_w", "capture_h", "capture_ms", "inference_ms", "draw_ms", "display_ms", "fps", "fps_gate_valid", "model", "device", "frame_path", "notes",
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A clip label file; relative clip paths are taken from its folder, 'none' and blanks are no expectation."""
    folder = F.lit(str(Path(path).parent))
    rows = spark.read.csv(path, header=True, schema=LABELS_SCHEMA)
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("expected", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "none")))
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(folder, F.lit("/"), F.col("path")))
    return rows.select(full.alias("path"), F.trim("split").alias("split"), parts.alias("expected"), F.coalesce("note", F.lit("")).alias("note"))


def labels_for_csv(clips: DataFrame) -> DataFrame:
    """Clips as the rows of a label file: expectations sorted and joined with ';', or 'none'."""
    joined = F.array_join(F.array_sort("expected"), ";")
    return clips.select("path", "split", F.coalesce(F.when(joined != "", joined), F.lit("none")).alias("expected"), F.coalesce("note", F.lit("")).alias("note"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, one file per partition."""
    df.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results file of text columns; what doesn't parse as a number is NULL in ``confidence_value``."""
    rows = spark.read.csv(path, header=True, schema=T.StructType([T.StructField(c, T.StringType()) for c in RESULT_COLUMNS]), enforceSchema=False)
    return rows.withColumn("confidence_value", F.col("confidence").try_cast("double"))


def result_rows(frames: DataFrame) -> DataFrame:
    """A row per detection of a frame (array ``detections`` of label, confidence, bbox), or one row for a miss."""
    each = frames.withColumn("d", F.explode_outer("detections"))
    number = F.bround(F.col("d.confidence").cast("decimal(20,10)"), 2).cast("string")
    return each.select(*(c for c in frames.columns if c != "detections"), F.coalesce("d.label", F.lit("")).alias("label"), F.coalesce(number, F.lit("")).alias("confidence"), "d.bbox", F.col("d").isNull().alias("missed"))


def gate_counts(results: DataFrame, threshold: float = 0.40, most_distance: float = 2.0) -> DataFrame:
    """Per object the results within the distance, and those of them that reach the threshold."""
    near = F.col("distance_m").try_cast("double") <= most_distance
    return results.where(near).groupBy("object").agg(F.count("*").alias("trials"), F.count_if(F.col("confidence_value") >= threshold).alias("hits"))


def save_threshold(path: str, threshold: float, meta: dict) -> None:
    Path(path).write_text(json.dumps({"threshold": threshold, **meta}, ensure_ascii=False, indent=1), encoding="utf-8")


def load_threshold(path: str, split: str = "Validation") -> float:
    """The saved threshold; one that was chosen on another split is refused."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("split") != split:
        raise ValueError(f"the threshold was chosen on {data.get('split')!r}, not on {split}")
    return float(data["threshold"])


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table as Markdown. A report is short: more rows than ``most`` are an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows; write it as CSV")
    cell = lambda v: "-" if v is None else str(v).replace("|", "\\|")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def label_tree(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """The pictures of a tree split/images, each with the lines of split/labels that has its stem: split, name, path, lines."""
    at = lambda c, kind: F.regexp_extract(c, rf"/([^/]+)/{kind}/([^/]+)\.[^./]+$", 1)
    stem = lambda c, kind: F.regexp_extract(c, rf"/([^/]+)/{kind}/([^/]+)\.[^./]+$", 2)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    pictures = files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")).select("path", at("path", "images").alias("split"), stem("path", "images").alias("stem")).where("split <> ''")
    texts = files.where(F.lower("path").endswith(".txt")).select(at("path", "labels").alias("split"), stem("path", "labels").alias("stem"), F.split(F.trim(F.decode("content", "UTF-8")), r"\r?\n").alias("lines"))
    named = pictures.where(F.col("split").isin(list(splits)))
    return named.join(texts, ["split", "stem"], "left").select("split", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path", F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x != "").alias("lines"))


def listed(spark: SparkSession, folder: str, suffixes: tuple[str, ...], prefix: str = "") -> DataFrame:
    """The files of a folder and all below it: path, name, and whether the name has the prefix and a suffix (any case).

    Bad names stay in the table, so that a report can name them; take ``good`` to skip them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    ends = F.lower(name).rlike(rf"\.({'|'.join(s.lower().lstrip('.') for s in suffixes)})$")
    return files.select("path", name.alias("name"), (ends & F.lower(name).startswith(prefix.lower())).alias("good"))


def negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Added negatives: the pictures of a folder and all below it, named by their flattened path: path, name, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(r"\.(jpg|jpeg|png)$"))
    inner = F.regexp_replace(F.col("path"), f"^.*?{re.escape(str(Path(folder)))}/", "")
    return files.select("path", F.concat(F.lit("neg__"), F.regexp_replace(inner, "/", "__")).alias("name"), "content")


def unique_names(df: DataFrame, name: str) -> DataFrame:
    """The names that occur more than once."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


@udtf(returnType="name string, content binary")
class ZipMembers:
    """The members of an archive's bytes whose path has the given number of parts; all of them for 0.

    Those with the part ``unread`` in their path are named but never read: their content is NULL.
    """

    def eval(self, content: bytes, parts: int, unread: str):  # noqa: ANN201
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                path = info.filename.split("/")
                if not info.is_dir() and (not parts or len(path) == parts):
                    yield info.filename, None if unread and unread in path[:-1] else z.read(info)


def zip_members(spark: SparkSession, path: str, parts: int = 0, unread: str = "") -> DataFrame:
    """The members of archives: archive, name, content. An archive is opened by the task that reads it."""
    spark.udtf.register("sightline_zip_members", ZipMembers)
    spark.read.format("binaryFile").load(path).createOrReplaceTempView("sightline_archives")
    return spark.sql(f"SELECT a.path AS archive, m.name, m.content FROM sightline_archives a, LATERAL sightline_zip_members(a.content, {int(parts)}, :unread) m", args={"unread": unread})


def pack_zip(folder: str, target: str, forbidden: str) -> int:
    """Pack a folder; a path with the forbidden name in it is refused before anything is written."""
    files = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    bad = [p for p in files if forbidden in str(p)]
    if bad:
        raise ValueError(f"forbidden path: {bad[0]}")
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(folder))
    return len(files)


def write_sides(items: DataFrame, path: str) -> None:
    """A split data set by side; an existing one is never overwritten."""
    items.write.mode("errorifexists").partitionBy("side").parquet(path)
