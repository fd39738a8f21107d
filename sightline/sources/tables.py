"""Readers of the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import cut, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, name: str, keys: list[str], order: str, *columns: str) -> DataFrame:
    """The row of each key that is first in ``order``: the keys and ``columns``.

    Only the keys that come more than once are sought out, by their columns alone; of these few the place of the first
    row in the files is kept, and all rows pass a join with them. So wide rows aren't shuffled, as an aggregation of the
    rows themselves would do. Queries of a session over the same files share the places found. NULL is an ordinary value of a key; rows equal in ``order`` are told apart by their place.
    """
    rows = table(spark, sf_dir, name).select(*keys, order, *columns, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("__row"))
    mark = (*_state(spark, f"{sf_dir}/{name}.parquet"), *keys, order)
    if mark not in _shared:
        if len(_shared) > 50:
            _shared.clear()
        _shared[mark] = _first_places(rows, keys, order)
    first = _shared[mark]
    names = [f"__k{i}" for i in range(len(keys))]
    kept = rows.join(first, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], "left").where("__kept IS NULL OR __kept = __row")
    return kept.select(*keys, *columns)


#: The places found in this session, by the state of the files, so that queries over one table share them.
_shared: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when files of a table come, go or grow: session, path, time, number and length of the files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(at)
    return spark.sparkContext.applicationId, path, fs.getFileStatus(at).getModificationTime(), summary.getFileCount(), summary.getLength()


def _first_places(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The place (``__kept``) of the first row of each key that comes more than once."""
    slim = rows.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(order).alias("__order"), F.col("__row").alias("__at"))
    names = [f"__k{i}" for i in range(len(keys))]
    twice = slim.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in names))
    among = slim.join(twice, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in names], "left_semi")
    return small(cut(among.groupBy(*names).agg(F.min(F.struct("__order", "__at")).alias("r")).select(*names, F.col("r.__at").alias("__kept"))))
