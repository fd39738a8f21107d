"""Preparation of labelled image sets: group keys, near-duplicate hashes, splits by whole groups, relocation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.ordered import global_rank
from sightline.session import cut, range_width

#: A name's export suffix, its left-over extension, its trailing counter, and groups that stand for nothing.
EXPORT_SUFFIX, EXTENSION, COUNTER = r"(?i)_(?:jpg|jpeg|png)\.rf\..*$", r"(?i)[_\-](?:jpe?g|png|webp)$", r"[\s_\-()0-9]+$"
NUMERIC_ONLY, PER_IMAGE_GROUPS = "<numeric-only>", ("<numeric-only>", "gambar")


def source_group(name: Column) -> Column:
    """The source that an image's file name points to."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, EXPORT_SUFFIX, ""), EXTENSION, ""), COUNTER, "")
    return F.when(base == "", NUMERIC_ONLY).otherwise(base)


def split_key(name: Column) -> Column:
    """The key that keeps an image with its likes: its group, or itself where the group says nothing."""
    g = source_group(name)
    return F.when(g.isin(list(PER_IMAGE_GROUPS)), F.concat(F.lit("id:"), F.regexp_replace(name, EXPORT_SUFFIX, ""))).otherwise(g)


def negative_group(name: Column) -> Column:
    """The key of an added negative (neg__a__b__file): its folders; other names keep their split key."""
    parts = F.split(name, "__")
    return F.when(name.startswith("neg__"), F.concat(F.lit("neg:"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "/"))).otherwise(split_key(name))


def class_of(name: Column, positive: str = "smoking_", negative: str = "notsmoking_") -> Column:
    """1 or 0 by the name's prefix; the negative one is tried first; NULL for neither."""
    n = F.lower(name)
    return F.when(n.startswith(negative), 0).when(n.startswith(positive), 1)


def keep_class(line: Column, class_id: int) -> Column:
    """A label line of five parts of the class, renumbered to 0; NULL for all others."""
    parts = F.split(F.trim(line), r"\s+")
    good = (F.size(parts) == 5) & (F.get(parts, 0).try_cast("int") == class_id)
    return F.when(good, F.concat(F.lit("0 "), F.array_join(F.slice(parts, 2, 4), " ")))


def dhash(pixels: Column, columns: int = 9, rows: int = 8) -> Column:
    """The difference hash of a grey picture as an array row by row: a bit for each place brighter than the one before."""
    width = columns - 1

    def bit(i: Column) -> Column:
        at = F.floor(i / width).cast("int") * columns + (i % width)
        return F.when(F.get(pixels, at + 1) > F.get(pixels, at), 1).otherwise(0).cast("bigint")

    places = F.sequence(F.lit(0), F.lit(width * rows - 1))
    return F.when(F.size(pixels) == columns * rows, F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(bit(i))))


def sign_hash(vector: Column) -> Column:
    """The signs of up to 64 numbers as bits, the first one lowest."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bits), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x))


def band_plan(max_bits: int, count: int, bits: int = 64) -> list[tuple[int, int, list[int]]]:
    """How to find hashes at most ``max_bits`` apart among ``count``: bands as (first bit, width, masks to flip).

    Two such hashes lie at most max_bits // m apart in one of m bands, and not all of the first max_bits % m + 1 bands and
    the others one further, so that the others may be probed with a bit less. More hashes make wider bands pay: of all m
    the one is taken with the fewest probes and candidates for each hash.
    """
    best: tuple[float, list[tuple[int, int, int]]] | None = None
    for m in range(1, min(bits, max_bits + 1) + 1):
        first, bands = 0, []
        for i in range(m):
            width = bits // m + (i < bits % m)
            bands.append((first, width, max_bits // m - (i > max_bits % m)))
            first += width
        balls = [(w, sum(comb(w, k) for k in range(r + 1))) for _, w, r in bands if r >= 0]
        cost = sum(n + count * n / 2**w for w, n in balls)
        if best is None or cost < best[0]:
            best = cost, [b for b in bands if b[2] >= 0]
    return [(f, w, [sum(1 << b for b in c) for n in range(r + 1) for c in combinations(range(w), n)]) for f, w, r in best[1]]


def near_candidates(left: DataFrame, right: DataFrame, max_bits: int, bits: int = 64) -> DataFrame:
    """The pairs (l, r) of hash values that meet in a band; a pair may come more than once."""
    lo, hi = (d.select(F.col("hash").alias(c)).where(F.col(c).isNotNull()).distinct() for d, c in ((left, "l"), (right, "r")))
    plan = band_plan(max_bits, hi.agg(F.approx_count_distinct("r")).first()[0], bits)

    def part(h: Column, first: int, width: int) -> Column:
        return F.call_function("shiftrightunsigned", h, F.lit(first)).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    def numbers(values: list[int]) -> Column:
        return F.split(F.lit(",".join(str(v - (1 << 64) if v >> 63 else v) for v in values)), ",").cast("array<bigint>")

    def probe(k: int, first: int, width: int, masks: list[int]) -> Column:
        key = part(F.col("l"), first, width)
        return F.transform(numbers(masks), lambda m: F.struct(F.lit(k).alias("band"), key.bitwiseXOR(m).alias("key")))

    probes = F.concat(*(probe(k, *band) for k, band in enumerate(plan)))
    own = F.array(*(F.struct(F.lit(k).alias("band"), part(F.col("r"), f, w).alias("key")) for k, (f, w, _) in enumerate(plan)))
    lo, hi = (d.select(c, F.explode(x).alias("p")).select(c, "p.band", "p.key") for d, c, x in ((lo, "l", probes), (hi, "r", own)))
    return lo.join(hi, ["band", "key"]).select("l", "r")


def near_hashes(left: DataFrame, right: DataFrame, max_bits: int, bits: int = 64) -> DataFrame:
    """Pairs of different or equal hash values (l, r, bits) at most ``max_bits`` apart; each side has a column ``hash``.

    Exact: the left side probes its bands with all flips within their radius and meets the right side by equal bands
    (:func:`band_plan`). Only distinct hashes take part, however often they repeat; NULL meets nothing. Up to about a
    tenth of the bits the work grows little faster than the rows; a radius near a third of them is a comparison of all
    with all, whatever the bands.
    """
    apart = F.bit_count(F.col("l").bitwiseXOR(F.col("r")))
    return near_candidates(left, right, max_bits, bits).withColumn("bits", apart).where(F.col("bits") <= max_bits).distinct()


def nearest(others: DataFrame, reference: DataFrame, max_bits: int) -> DataFrame:
    """For each of ``others`` (id, hash) the nearest of ``reference`` (ties: the smallest id): id, near_id, bits."""
    near = near_hashes(others, reference, max_bits)
    names = reference.groupBy("hash").agg(F.min("id").alias("near_id"))
    best = near.join(names, near["r"] == names["hash"]).groupBy("l").agg(F.min(F.struct("bits", "near_id")).alias("b"))
    return others.join(best, others["hash"] == best["l"]).select("id", "b.near_id", "b.bits")


def near_any(others: DataFrame, reference: DataFrame, max_bits: int) -> DataFrame:
    """Those of ``others`` that have a near one in ``reference``."""
    hit = near_hashes(others, reference, max_bits).select(F.col("l").alias("hash")).distinct()
    return others.join(hit, "hash", "left_semi")


def relocate(items: DataFrame, max_bits: int) -> DataFrame:
    """``items`` (id, grp, side, hash) after moving every val group with a picture near a train picture, until none is left.

    Each round compares only what the last one moved. Rounds are cut to the shared folder.
    """
    state = cut(items.select("id", "grp", "side", "hash"))
    fresh = state.where("side = 'train'")
    while True:
        bad = cut(near_any(state.where("side = 'val'"), fresh, max_bits).select("grp").distinct())
        if bad.isEmpty():
            return state
        flagged = bad.withColumn("bad", F.lit(True))
        moved = state.join(flagged, "grp", "left").withColumn("gone", F.coalesce("bad", F.lit(False)) & (F.col("side") == "val"))
        moved = cut(moved.select("id", "grp", F.when(F.col("gone"), "train").otherwise(F.col("side")).alias("side"), "hash", "gone"))
        fresh, state = moved.where("gone").drop("gone"), moved.drop("gone")


def seeded_split(df: DataFrame, class_col: str, name: str, seed: int = 0, fraction: float = 0.15) -> DataFrame:
    """Per class the first part of the names in seeded hash order goes to val, the rest to train."""
    keyed = df.select(F.col(class_col).alias("class"), F.col(name).alias("name")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("name").cast("string"))))
    ranked = global_rank(keyed, ["class"], ["h", "name"])
    size = keyed.groupBy("class").agg(F.floor(F.count("*") * fraction + F.lit(0.5)).alias("val"))
    return ranked.join(size, "class").select("class", "name", F.when(F.col("rank") <= F.col("val"), "val").otherwise("train").alias("side"))


def _sizes(items: DataFrame, seed: int) -> DataFrame:
    one = items.groupBy("grp").agg(F.count("*").alias("size"), F.max(F.col("flag").cast("int")).alias("stratum"))
    return one.withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), "grp")))


def take_in_order(sizes: DataFrame, limits: dict[int | None, tuple[float, float]]) -> DataFrame:
    """The groups (grp, size, stratum) taken one after another in order of h, per stratum with limits (enough, most).

    A group is taken while less than ``enough`` is taken and it doesn't bring the sum above ``most``; others are passed
    over. The groups are range-sorted, and for each partition the sum of those that still fit is known: as long as whole
    partitions fit, they are taken whole by these sums. Only the partition in which the rule refuses a group is walked,
    in one task, and then the rest is summed again without the groups that are too large by now. So the rounds are as
    many as partitions in which something is refused that fitted before, mostly one or two a stratum.
    """
    spark, order = sizes.sparkSession, ["stratum", "h", "grp"]
    ordered = sizes.repartitionByRange(range_width(spark), *order).sortWithinPartitions(*order)
    ordered = cut(ordered.select("grp", "size", "stratum", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("at")))
    taken = [sizes.select("grp", "size", "stratum").limit(0)]
    for stratum, (enough, most) in limits.items():
        total, after = 0, -1
        while total < enough:
            left = ordered.where(F.col("stratum").eqNullSafe(F.lit(stratum)) & (F.col("pid") > after) & (total + F.col("size") <= most))
            cells = sorted(left.groupBy("pid").agg(F.sum("size"), F.max_by("size", "at")).collect())  # one row per partition
            whole, walked = [], None
            for pid, size, last in cells:
                if total + size > most or total + size - last >= enough:
                    walked = pid
                    break
                whole.append(pid)
                total += size
            if whole:
                taken.append(left.where(F.col("pid").between(whole[0], whole[-1])).select("grp", "size", "stratum"))
            if walked is None:
                break

            def walk(pdfs: Iterator[pd.DataFrame], total: int = total, enough: float = enough, most: float = most) -> Iterator[pd.DataFrame]:
                for pdf in pdfs:
                    yes = []
                    for size in pdf["size"].tolist():
                        yes.append(total < enough and total + size <= most)
                        total += size if yes[-1] else 0
                    yield pdf[yes]

            found = cut(left.where(F.col("pid") == walked).select("grp", "size", "stratum").mapInPandas(walk, taken[0].schema))
            taken.append(found)
            total, after = total + (found.agg(F.sum("size")).first()[0] or 0), walked
    return reduce(DataFrame.unionAll, taken)


def grouped_split(items: DataFrame, seed: int = 0, fraction: float = 0.15) -> DataFrame:
    """``items`` (id, grp, flag) with ``side``: whole groups, in seeded hash order per stratum (a flagged item or none).

    A group goes to val while that is short of its part and the group doesn't overfill it, else to train.
    """
    sizes = _sizes(items, seed)
    target = {r[0]: int(r[1] * fraction + 0.5) for r in sizes.groupBy("stratum").agg(F.sum("size")).collect()}  # two or three strata
    val = take_in_order(sizes, {k: (t, t * 1.2 + 1) for k, t in target.items()})
    side = F.when(F.col("val"), "val").otherwise("train").alias("side")
    return items.join(val.select("grp", F.lit(True).alias("val")), "grp", "left").where("grp IS NOT NULL").select("id", "grp", "flag", side)


def groups_under_cap(items: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Whole groups in seeded hash order while they fit under ``cap`` items; one that doesn't is passed over."""
    return take_in_order(_sizes(items, seed).withColumn("stratum", F.lit(0)), {0: (float("inf"), cap)}).select("grp", "size")


def split_report(items: DataFrame) -> DataFrame:
    """Per side: pictures, flagged and other ones, and distinct groups."""
    return items.groupBy("side").agg(F.count("*").alias("images"), F.count_if("flag").alias("positives"), F.count_if(~F.col("flag")).alias("negatives"), F.count_distinct("grp").alias("groups"))


def assert_disjoint(items: DataFrame) -> DataFrame:
    """The groups that stand on more than one side; none, if the split is sound."""
    return items.groupBy("grp").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select("grp")


def refuse_paths(df: DataFrame, path: str, forbidden: str) -> DataFrame:
    """``df``, failing at run time on a path that contains the forbidden folder."""
    return df.where(F.when(F.col(path).contains(forbidden), F.raise_error(F.concat(F.lit("forbidden path: "), F.col(path))).cast("boolean")).otherwise(F.lit(True)))


IMAGE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("grp", T.StringType()), T.StructField("side", T.StringType()), T.StructField("hash", T.LongType())])
