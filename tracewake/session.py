"""Session settings, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of the optimizer's estimate, that may be broadcast.
BROADCAST_BYTES = 8 << 20

#: Scans up to this estimate may be shuffled to use all cores.
SPREAD_BYTES = 1 << 30

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go when nothing refers to them any more; a cluster sets this itself, as it counts at the start only
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build(master: str = "local[8]", **extra: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    conf = SETTINGS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | extra
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for clusters whose Python path lacks it."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)  # the driver serves the file; executors fetch their own copies


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder; make a local one only for a local master."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
        return
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewake-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """For costly work per row on a small plain scan: as many partitions as cores, if the files give fewer.

    Inputs above SPREAD_BYTES stay as they are, unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(scan) > SPREAD_BYTES or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; an upper bound for scans and projections of files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only below the limit; else leave the choice to AQE."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
