"""Scoring of clips and classifiers, decision gates, timed tests and latency statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The module in a clip's name and the event type it stands for; '' is none.
MODULES = {"hazard": "hazard_object", "smoking": "smoking", "fight": "fight", "climbing": "climbing", "outarea": "out_of_area", "normal": ""}


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def clip_name(path: Column) -> dict[str, Column]:
    """The parts of a name like module_polarity_session_number[_group]; ``problem`` says why a name doesn't follow it."""
    parts = F.split(F.lower(stem(path)), "_")
    module, polarity, session = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    problem = (
        F.when(path.isNull() | (F.size(parts) < 4), "too few parts")
        .when(~module.isin(list(MODULES)), "unknown module")
        .when(~polarity.isin("pos", "neg"), "unknown polarity")
        .when((module == "normal") & (polarity == "pos"), "normal clips are negative")
        .when(~session.rlike("^s[0-9]+$"), "unknown session")
    )
    kinds = F.create_map(*(F.lit(x) for pair in MODULES.items() for x in pair))
    kind = F.try_element_at(kinds, module)
    good = problem.isNull()
    return {"module": F.when(good, module), "polarity": F.when(good, polarity), "session": F.when(good, session), "event_type": F.when(good & (kind != ""), kind), "group": F.when(F.size(parts) >= 5, F.get(parts, 4)), "problem": problem}


def clip_scores(clips: DataFrame) -> DataFrame:
    """Per event type that a clip expects or fired: hits, misses, and false alarms per hour of clips that don't expect it.

    ``clips``: expected (array), fired (map), duration_s. A clip meets only the types it names; what it adds to the
    negatives of all others comes from the totals, so clips and types are never crossed.
    """
    seconds = F.coalesce(F.col("duration_s").cast("decimal(18,3)"), F.lit(0).cast("decimal(18,3)"))
    types = F.array_union(F.coalesce("expected", F.array().cast("array<string>")), F.coalesce(F.map_keys("fired"), F.array().cast("array<string>")))
    named = clips.select(seconds.alias("s"), "expected", "fired", F.explode(types).alias("event_type")).where("event_type IS NOT NULL")
    wanted = F.coalesce(F.array_contains("expected", F.col("event_type")), F.lit(False))
    fired = F.coalesce(F.try_element_at("fired", F.col("event_type")), F.lit(0))
    per = named.select("event_type", "s", wanted.alias("w"), fired.alias("f")).groupBy("event_type").agg(
        F.count_if(F.col("w") & (F.col("f") > 0)).alias("tp"), F.count_if(F.col("w") & (F.col("f") == 0)).alias("fn"), F.count_if(~F.col("w") & (F.col("f") > 0)).alias("fp_clips"),
        F.sum(F.when(~F.col("w"), F.col("f")).otherwise(0)).alias("fp_events"), F.sum(F.when(F.col("w"), F.col("s"))).alias("own"),
    )
    total = clips.agg(F.count("*").alias("n"), F.sum(seconds).alias("all"))
    joined = per.join(F.broadcast(total))  # one row
    negative = (F.col("all") - F.coalesce("own", F.lit(0))).cast("double")
    scored = joined.select("event_type", "tp", "fn", "fp_clips", (F.col("n") - F.col("tp") - F.col("fn")).alias("neg_clips"), "fp_events", negative.alias("neg_seconds"))
    return scored.withColumn("fp_per_hour", F.when(F.col("neg_seconds") > 0, F.col("fp_events") / (F.col("neg_seconds") / F.lit(3600.0))).otherwise(F.lit(0.0)))


@dataclass(frozen=True)
class Gate:
    """A decision gate on the test clips of a module, polarity and group."""

    module: str
    polarity: str
    group: str
    event_type: str
    count: str
    op: str
    k: int
    n: int
    label: str | None = None
    min_conf: float = 0.0


#: The approved gates.
GATES = (
    Gate("outarea", "pos", "crouchstay", "out_of_area", "alerted", ">=", 8, 10),
    Gate("outarea", "neg", "adultstand", "out_of_area", "alerted", "<=", 1, 10),
    Gate("outarea", "neg", "crouchpass", "out_of_area", "silent", ">=", 9, 10),
    Gate("fight", "pos", "staged", "fight", "alerted", ">=", 4, 6),
    Gate("fight", "neg", "daily", "fight", "alerted", "<=", 2, 8),
    Gate("hazard", "pos", "gate", "hazard_object", "label", ">=", 8, 10, "scissors", 0.40),
)


def gate_status(clips: DataFrame, gates: tuple[Gate, ...] = GATES, available: list[str] | None = None) -> DataFrame:
    """One row per gate with the clips found, those counted and the status. ``clips``: path, fired, max_conf (test only)."""
    rows = [(i, g.module, g.polarity, g.group, g.event_type, g.count, g.op, g.k, g.n, g.label, g.min_conf, available is None or g.event_type in available) for i, g in enumerate(gates)]
    table = clips.sparkSession.createDataFrame(rows, "gate int, module string, polarity string, grp string, event_type string, count string, op string, k int, n int, label string, min_conf double, ran boolean")
    parts = F.split(F.lower(stem(F.col("path"))), "_")
    tagged = clips.where(F.size(parts) >= 5).select(F.get(parts, 0).alias("module"), F.get(parts, 1).alias("polarity"), F.get(parts, 4).alias("grp"), "fired", "max_conf", F.lit(1).alias("clip"))
    joined = F.broadcast(table).join(tagged, ["module", "polarity", "grp"])
    alerted = F.coalesce(F.try_element_at("fired", F.col("event_type")), F.lit(0)) > 0
    labelled = F.coalesce(F.try_element_at("max_conf", F.col("label")), F.lit(0.0)) >= F.col("min_conf")
    hit = F.when(F.col("count") == "label", labelled).when(F.col("count") == "alerted", alerted).otherwise(~alerted)
    found = joined.groupBy("gate").agg(F.count("*").alias("clips"), F.count_if(hit).alias("counted"))
    all_gates = table.join(F.broadcast(found), "gate", "left").fillna(0, ["clips", "counted"])  # a row per gate
    ok = F.when(F.col("op") == ">=", F.col("counted") >= F.col("k")).otherwise(F.col("counted") <= F.col("k"))
    status = F.when(~F.col("ran"), "NOT RUN").when(F.col("clips") < F.col("n"), "INCOMPLETE").when(F.col("clips") > F.col("n"), "CHECK").when(ok, "PASS").otherwise("FAIL")
    return all_gates.select("gate", "event_type", "clips", "counted", status.alias("status"))


def frame_peaks(detections: DataFrame, keys: list[str], least: float = 0.40) -> DataFrame:
    """Per key and label: the best confidence and the frames whose best reaches ``least``; a frame counts once."""
    frames = detections.groupBy(*keys, "frame_index", "label").agg(F.max("confidence").alias("c"))
    return frames.groupBy(*keys, "label").agg(F.max("c").alias("best_conf"), F.count_if(F.col("c") >= least).alias("frames_over"), F.count("*").alias("frames"))


def clip_verdict(results: DataFrame, positives: int, least_detected: int, most_frames: int) -> DataFrame:
    """One row: the verdict on clips (kind 'pos' or 'neg', detected_frames)."""
    pos, neg = F.col("kind") == "pos", F.col("kind") == "neg"
    one = results.agg(F.count_if(pos).alias("pos_clips"), F.count_if(pos & (F.col("detected_frames") > 0)).alias("pos_detected"), F.count_if(neg).alias("neg_clips"), F.count_if(neg & (F.col("detected_frames") > most_frames)).alias("neg_failed"))
    open_ = (F.col("pos_clips") != positives) | (F.col("neg_clips") < 1)
    good = (F.col("pos_detected") >= least_detected) & (F.col("neg_failed") == 0)
    return one.withColumn("status", F.when(open_, "INCOMPLETE").when(good, "PASS").otherwise("FAIL"))


def timed_test(frames: DataFrame, key: str, seconds: float, most: int) -> DataFrame:
    """Per key, over the first run of ``seconds``: frames, frames with a detection, and the status.

    ``frames``: key, t_ms, hit. A run without a frame at its end or later isn't finished.
    """
    begin = frames.groupBy(key).agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"))
    length = round(seconds * 1000)
    inside = frames.join(begin, key).where(F.col("t_ms") - F.col("t0") < length)
    one = inside.groupBy(key).agg(F.count("*").alias("frames"), F.count_if("hit").alias("detected"), F.max(F.col("t1") - F.col("t0")).alias("span"))
    return one.select(key, "frames", "detected", F.when(F.col("span") < length, "INCOMPLETE").when(F.col("detected") <= most, "PASS").otherwise("FAIL").alias("status"))


def trial_test(frames: DataFrame, key: str, trials: int, seconds: float, every: float, least: int) -> DataFrame:
    """Per key and trial (one each ``every`` seconds from the first frame): frames, detected, rate, best and mean confidence.

    ``frames``: key, t_ms, hit, conf_milli. Only trials that a frame at their end or later finishes count; ``status`` is the key's.
    """
    begin = frames.groupBy(key).agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1"))
    step, length = round(every * 1000), round(seconds * 1000)
    at = frames.join(begin, key).withColumn("trial", F.floor((F.col("t_ms") - F.col("t0")) / step))
    at = at.where((F.col("trial") < trials) & (F.col("t_ms") - F.col("t0") - F.col("trial") * step < length) & (F.col("t1") - F.col("t0") >= F.col("trial") * step + length))
    one = at.groupBy(key, "trial").agg(F.count("*").alias("frames"), F.count_if("hit").alias("detected"), F.max(F.when(F.col("hit"), F.col("conf_milli"))).alias("best_milli"), F.sum(F.when(F.col("hit"), F.col("conf_milli"))).alias("sum_milli"))
    status = one.groupBy(key).agg(F.count("*").alias("done"), F.count_if(F.col("detected") > 0).alias("hits"))
    status = status.select(key, F.when(F.col("done") < trials, "INCOMPLETE").when(F.col("hits") >= least, "PASS").otherwise("FAIL").alias("status"))
    return one.join(status, key).select(key, "trial", "frames", "detected", "best_milli", (F.col("detected") / F.col("frames")).alias("rate"), F.when(F.col("detected") > 0, F.col("sum_milli") / F.col("detected") / F.lit(1000.0)).otherwise(F.lit(0.0)).alias("mean_conf"), "status")


#: The thresholds that a sweep tries, from 0.05 to 0.95.
THRESHOLDS = [i / 20 for i in range(1, 20)]


def threshold_sweep(scores: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Confusion counts for each threshold and for no threshold (NULL). ``scores``: label (1 or 0), det_fired, cls_prob.

    Rows are counted once by the number of thresholds they pass; the sweep is a sum over those few counts.
    """
    levels = thresholds or THRESHOLDS
    passed = F.size(F.filter(F.array(*map(F.lit, levels)), lambda t: F.col("cls_prob") >= t))
    kinds = scores.select(F.col("label").alias("y"), F.coalesce(F.col("det_fired"), F.lit(False)).alias("d"), F.coalesce(passed, F.lit(0)).alias("p"))
    counts = kinds.groupBy("y", "d", "p").agg(F.count("*").alias("n"))
    table = scores.sparkSession.createDataFrame([(-1, None), *enumerate(levels)], "i int, threshold double")
    each = F.broadcast(table).crossJoin(counts)  # a few hundred counts at most
    fired = F.col("d") & (F.col("p") > F.col("i"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    swept = each.groupBy("i", "threshold").agg(total(fired & (F.col("y") == 1)).alias("tp"), total(~fired & (F.col("y") == 1)).alias("fn"), total(fired & (F.col("y") != 1)).alias("fp"), total(~fired & (F.col("y") != 1)).alias("tn"))
    return swept.select("threshold", "tp", "fn", "fp", "tn", F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0)).alias("recall"))


def choose_threshold(sweep: DataFrame, max_recall_drop: float = 0.05) -> DataFrame:
    """The threshold with the fewest false alarms (ties: the smallest) that keeps the recall, and whether it is adopted."""
    base = sweep.where("threshold IS NULL").select(F.col("tp").alias("base_tp"), F.col("fp").alias("base_fp"), F.col("recall").alias("base_recall"))
    kept = sweep.where("threshold IS NOT NULL").join(F.broadcast(base)).where(F.col("recall") >= F.col("base_recall") - max_recall_drop - 1e-9)
    best = kept.agg(F.min(F.struct("fp", "threshold", "tp", "recall")).alias("b"))
    return F.broadcast(base).join(best).select(F.col("b.threshold").alias("threshold"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"), "base_tp", "base_fp", F.coalesce(F.col("b.fp") < F.col("base_fp"), F.lit(False)).alias("adopted"))


def overall(statuses: DataFrame) -> DataFrame:
    """Many results (``status``) as one: how many, those that passed, and PASS only if all did. No results are none."""
    passed = F.col("status") == "PASS"
    return statuses.agg(F.count("*").alias("keys"), F.count_if(passed).alias("passed"), F.when(F.bool_and(passed), "PASS").otherwise("FAIL").alias("overall"))


def of_split(clips: DataFrame, which: str) -> DataFrame:
    """The clips of a split, whatever its case and blanks; 'all' takes every clip, those without a split too."""
    if which not in ("tune", "test", "all"):
        raise ValueError(f"unknown split {which!r}")
    return clips if which == "all" else clips.where(F.lower(F.trim("split")) == which)


def first_and_more(df: DataFrame, name: str, most: int = 50) -> DataFrame:
    """The first ``most`` names in order as ``line``, and a last line that says how many more there are."""
    first = df.orderBy(name).limit(most).select(F.col(name).alias("line"))
    rest = df.agg((F.count("*") - most).alias("n")).where("n > 0").select(F.concat(F.lit("... "), F.col("n").cast("string"), F.lit(" more")).alias("line"))
    return first.unionAll(rest)


def split_counts(items: DataFrame, origins: list[str]) -> DataFrame:
    """Per side: pictures, flagged and other ones, boxes, distinct groups, and a column of pictures for each origin."""
    by = [F.count_if(F.col("origin") == o).alias(o) for o in origins]
    return items.groupBy("side").agg(F.count("*").alias("images"), F.count_if("flag").alias("positives"), F.count_if(~F.col("flag")).alias("negatives"), F.sum("boxes").alias("boxes"), F.count_distinct("grp").alias("groups"), *by)


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the later of two."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def median_of(values: Column) -> Column:
    """The median of an array, the mean of the two middles."""
    s = F.array_sort(values)
    n = F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / F.lit(2.0))


def tenths(values: Column) -> Column:
    """The finite values of at least 0 of an array, in whole tenths."""
    good = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < 1e15))
    return F.transform(good, lambda x: F.round(x * 10).cast("bigint"))


def rolling(df: DataFrame, keys: list[str], values: str, width: int = 30) -> DataFrame:
    """For each place of a BIGINT array the sum, count and median of the last ``width`` values: keys, pos, total, n, median.

    A row's array holds the whole sequence, so nothing is shuffled; all windows of an Arrow batch are sorted at once.
    """
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("pos", T.LongType()), T.StructField("total", T.LongType()), T.StructField("n", T.LongType()), T.StructField("median", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(keys))
            flat, length = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
            if not len(flat):
                continue
            row = np.repeat(np.arange(b.num_rows), length)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            n = np.minimum(pos + 1, width)
            sums = np.concatenate([[0], np.cumsum(flat)])
            end = np.arange(1, len(flat) + 1)
            median = np.empty(len(flat))
            padded = np.concatenate([np.full(width - 1, np.iinfo(np.int64).max), flat])
            windows = np.lib.stride_tricks.sliding_window_view(padded, width)
            for s in range(0, len(flat), 200_000):
                own = n[s : s + 200_000]
                part = np.where(np.arange(width) >= width - own[:, None], windows[s : s + 200_000], np.iinfo(np.int64).max)
                part.sort(axis=1)
                at = np.arange(len(own))
                median[s : s + 200_000] = (part[at, (own - 1) // 2] + part[at, own // 2]) / 2.0
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), pa.array(pos), pa.array(sums[end] - sums[end - n]), pa.array(n), pa.array(median)], names=schema.names)

    return df.select(*keys, values).where(F.size(values) > 0).mapInArrow(run, schema)
