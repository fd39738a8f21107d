"""Splits that keep related records together.

Records that share a key (a source, an author, an entity) belong together, also through other records. Only the keys
are linked: a record hangs on its first key and links it to its other ones, so that a record with one key, and a key that
a third of all records share, take no part in the contraction. Borůvka-style rounds contract the links: each component
picks its smallest neighbour, the picked links join the spanning forest, pointer doubling finds the roots, and links are
renamed to roots, with loops and repeats dropped, until none is left. What a round picked, forest edges included, and
where it led stay in tables written to the shared checkpoint folder; nothing is collected.

The sets are then dealt by size band, the largest first. In each band the splits get their numbers of sets by what they
still need, spread evenly over the band in the order of a hash; what the sets of the band hold is counted before the next
one is dealt. The one rule serves a set with a third of all records and millions of single ones alike.

Defined results: records with a NULL id are left out; a NULL path or a record without keys is a set of its own; repeated
ids count as one record with all their keys; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import cut, range_width, small

#: The parts of all records that the splits should get.
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Keys and their roots up to this number are broadcast once counted; more are joined by shuffling.
SMALL = 100_000


def path_keys(path: Column) -> Column:
    """The recordings (``rec``) and performers (``act``) that a path names, without case, separators and leading zeros."""
    named = F.regexp_extract_all(F.lower(path), F.lit("(?<![a-z])(?:rec|act)[ _-]?[0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(x, "[ _-]", ""), "(?<=[a-z])0+(?=[0-9])", "")))


def split_key(split: Column) -> Column:
    """A split without case and outer blanks; tune is train, valid and validation are val; '' is none."""
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(s == "tune", "train").when(s.isin("valid", "validation"), "val").when(s != "", s)


def keyed(df: DataFrame, record_id: Column, keys: Column) -> DataFrame:
    """``id``, its keys without NULLs and repeats, and the first of them; a row for each row of ``df`` with an id."""
    own = F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))
    rows = df.select(record_id.alias("id"), own.alias("keys")).where("id IS NOT NULL")
    return rows.select("id", "keys", F.try_element_at("keys", F.lit(1)).alias("key"))


def key_links(rows: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between keys that share a record, each with the record ``id`` and the key ``other`` it reaches.

    A record links the smallest of its keys, over all its rows, to its others.
    """
    several = cut(rows.where("key IS NOT NULL").groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").select("id", "least"))
    each = rows.join(small(several), "id", "left").select("id", F.coalesce("least", "key").alias("key"), F.explode("keys").alias("other")).where("key <> other")
    both = each.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"), "id", "other")
    return both.groupBy("a", "b").agg(F.min(F.struct("id", "other")).alias("via")).select("a", "b", "via")


def contract(links: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of each round the forest edges it picked (``via``) and where it led (a, root)."""
    edges = cut(links)
    forest, led = [], []
    while not edges.isEmpty():
        ways = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "via"))
        pick = cut(ways.groupBy("a").agg(F.min(F.struct("b", "via")).alias("p")).select("a", "p.b", "p.via"))
        # of two that picked each other the smaller is the root
        back = pick.select(F.col("a").alias("b"), F.col("b").alias("back"))
        root = (F.col("back") == F.col("a")) & (F.col("a") < F.col("b"))
        light = F.broadcast if pick.count() <= SMALL else lambda df: df
        hooked = light(pick).join(back, "b").select("a", F.when(root, F.col("a")).otherwise(F.col("b")).alias("root"), F.when(~root, F.col("via")).alias("via"))
        hooked = cut(hooked)
        forest.append(hooked.where("via IS NOT NULL").select("via"))
        parent = hooked.select("a", "root")
        while True:
            once = _up(parent, parent, light)
            twice = _up(once.withColumn("was", F.col("root")), once, light)
            parent = cut(twice.select("a", "root", (F.col("root") != F.col("was")).alias("moved")))
            moved, parent = not parent.where("moved").isEmpty(), parent.select("a", "root")
            if not moved:
                break
        led.append(parent)
        up = light(parent)
        one = edges.join(up, "a").select(F.col("root").alias("x"), "b", "via")
        two = one.join(up.select(F.col("a").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        edges = cut(two.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("via").alias("via")))
    return forest, led


def _up(parent: DataFrame, above: DataFrame, light: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each pointer led on by those of ``above``."""
    higher = light(above.select(F.col("a").alias("root"), F.col("root").alias("top")))
    return parent.join(higher, "root").select(*(F.col("top").alias("root") if c == "root" else c for c in parent.columns))


def key_roots(led: list[DataFrame], links: DataFrame) -> DataFrame:
    """The root of each linked key (key, root), through the rounds from the last one back."""
    if not led:
        return links.select(F.col("a").alias("key"), F.col("a").alias("root")).limit(0)
    roots = led[-1]
    for earlier in led[-2::-1]:
        later = small(roots.select(F.col("a").alias("root"), F.col("root").alias("top")))
        roots = earlier.join(later, "root", "left").select("a", F.coalesce("top", "root").alias("root"))
    return roots.select(F.col("a").alias("key"), "root")


def linked_sets(df: DataFrame, record_id: Column, keys: Column) -> DataFrame:
    """``id`` and ``set_id`` of each record; ``set_id`` is the smallest id of the set."""
    rows = keyed(df, record_id, keys)
    links = key_links(rows)
    _, led = contract(links)
    first = cut(rows.groupBy("id").agg(F.min("key").alias("key")))
    roots = cut(key_roots(led, links))
    least = first.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    rooted = least.join(small(roots), "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("set_id"))
    sets = cut(rooted.join(named, "root").select("key", "set_id"))
    return first.join(small(sets), "key", "left").select("id", F.coalesce("set_id", "id").alias("set_id"))


def record_forest(df: DataFrame, record_id: Column, keys: Column) -> DataFrame:
    """A spanning forest of records and keys, as edges (id, key): each record on its first key, and a record to a further
    key for each link of keys that the rounds picked. A set of r records and k keys has r + k - 1 edges."""
    rows = keyed(df, record_id, keys)
    forest, _ = contract(key_links(rows))
    first = rows.where("key IS NOT NULL").groupBy("id").agg(F.min("key").alias("key"))
    return reduce(DataFrame.unionAll, [f.select("via.id", F.col("via.other").alias("key")) for f in forest], first)


def torn_sets(sets: DataFrame, splits: DataFrame) -> DataFrame:
    """The records (id, set_id) of the sets in which two or more different splits occur; ``splits`` has id and split."""
    seen = splits.where("split IS NOT NULL").join(sets, "id")
    torn = seen.groupBy("set_id").agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x <> y").select("set_id")
    return sets.join(torn, "set_id").select("id", "set_id")


def apportion(n: int, room: dict[str, float]) -> dict[str, int]:
    """``n`` sets in proportion to the room, rounded to whole ones by the largest remainders."""
    room = {k: max(0.0, v) for k, v in room.items()}
    total = sum(room.values())
    exact = {k: n * v / total if total else float(n * (k == next(iter(room)))) for k, v in room.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], list(room).index(k)))[: n - sum(out.values())]:
        out[k] += 1
    return out


def spread(rank: Column, n: int, counts: dict[str, int]) -> Column:
    """The split of the set at ``rank`` (from 0) of n: each split gets its count, at even distances."""
    (last, _), *others = counts.items()
    out, left = F.lit(last), n
    chosen = []
    for name, k in others:
        step = lambda x, k=k, m=max(left, 1): ((x * k - (x * k) % m) / m).cast("bigint")
        chosen.append((name, step(rank + 1) > step(rank)))
        rank, left = rank - step(rank), left - k
    for name, hit in reversed(chosen):
        out = F.when(hit, name).otherwise(out)
    return out


def deal(sets: DataFrame, seed: int = 0) -> DataFrame:
    """``id``, ``set_id`` and ``split``: size bands from the largest down, each dealt by what the splits still need."""
    spark = sets.sparkSession
    sized = sets.groupBy("set_id").agg(F.count("*").alias("size"))
    sized = sized.select("set_id", "size", F.floor(F.log2("size")).cast("int").alias("band"), F.xxhash64(F.lit(seed), "set_id").alias("h"))
    order = [F.desc("band"), "h", "set_id"]
    ranked = sized.repartitionByRange(range_width(spark), *order).sortWithinPartitions(*order)
    ranked = cut(ranked.select("set_id", "size", "band", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    cells = ranked.groupBy("band", "pid").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.sum("size").alias("size")).collect()  # one row per partition and band
    room = {k: v * sum(c["size"] for c in cells) for k, v in SHARES.items()}
    dealt = []
    for band in sorted({c["band"] for c in cells}, reverse=True):
        base, n = [], 0
        for c in sorted((c for c in cells if c["band"] == band), key=lambda c: c["pid"]):
            base.append((c["pid"], n - c["at"]))
            n += c["n"]
        offsets = F.broadcast(spark.createDataFrame(base, "pid int, base long"))
        split = spread(F.col("at") + F.col("base"), n, apportion(n, room)).alias("split")
        dealt.append(ranked.where(F.col("band") == band).join(offsets, "pid").select("set_id", split, "size"))
        if band:
            for r in dealt[-1].groupBy("split").agg(F.sum("size").alias("size")).collect():
                room[r["split"]] -= r["size"]
    empty = ranked.select("set_id", F.lit("").alias("split"), "size").limit(0)
    named = cut(reduce(DataFrame.unionAll, dealt, empty).select("set_id", "split"))
    return sets.join(small(named), "set_id").select("id", "set_id", "split")
