"""Session helpers: local sessions for tests and benches, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "sightline", cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with the defaults the tests and the bench use."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SIGHTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors share and it is used as it is; a cluster
    session without one is an error. Only a local session (tests, a laptop) gets a temporary folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sightline-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, keeping its partitions, and go on from there.

    What the optimiser derived about ``df``'s values is left behind: over the rounds of an iteration such constraints
    multiply, until planning takes longer than the work.
    """
    ensure_checkpoint_dir(df.sparkSession)
    made = df.checkpoint(eager=True)
    jdf = made._jdf
    return DataFrame(jdf.sparkSession().internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), df.sparkSession)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it is counted to have at most so many rows (of a few numbers and short texts each).

    For tables that were cut: their size is unknown to the optimiser, and counting them is cheap. Larger ones stay as
    they are and are joined by shuffling.
    """
    return F.broadcast(df) if df.count() <= rows else df


def range_width(spark: SparkSession) -> int:
    """Partitions of a range sort: those the session shuffles into."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers of a session that was started elsewhere than beside it.

    Workers find it by PYTHONPATH or in their working folder; only where neither leads to it, the sources are added to
    the session as an archive, once.
    """
    root = Path(__file__).resolve().parent.parent
    known = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    sc = spark.sparkContext
    if any(p.resolve() == root for p in known if p.exists()) or getattr(sc, "_sightline_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="sightline-package-")) / "sightline_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "sightline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._sightline_shipped = True
