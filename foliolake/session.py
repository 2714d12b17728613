"""Session and cluster helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(name: str = "foliolake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and a small shuffle width."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, where the session isn't local, so that Python stages can import it there."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_foliolake_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "foliolake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._foliolake_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineages: spark.checkpoint.dir of the cluster; a folder of our own only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = os.path.join(tempfile.gettempdir(), f"foliolake-{os.getuid()}", uuid.uuid4().hex)
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder: computed once, read again by later branches, and safe when executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Estimated bytes of a partition from which on a frame has partitions enough by itself.
ENOUGH = 32 * 1024 * 1024


#: Kinds of plan node behind which the number of partitions isn't known before the run.
_SHUFFLED = ("Aggregate", "Join", "Repartition", "Window", "Sort")


def _nodes(plan: object) -> Iterator[str]:
    """The kinds of all nodes of a logical plan."""
    yield plan.nodeName()
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Enough partitions to keep every core busy before an expensive per-row stage.

    A large input has more partitions than that already and isn't shuffled; only a small number of files or of coalesced
    partitions is dealt out again. Nothing is run to find out: a scan is asked for its splits, and behind a shuffle,
    where the number isn't known before the run, Catalyst's size estimate decides.
    """
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(kind in node for node in _nodes(plan) for kind in _SHUFFLED):
        enough = int(str(plan.stats().sizeInBytes())) >= want * ENOUGH
    else:
        enough = df.rdd.getNumPartitions() * 2 > want
    return df if enough else df.repartition(want)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
