"""Spark session helpers.

The library never creates its own session in library code; callers pass one
in.  ``local_session`` is for tests, the bench and the smoke entry point.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "vigil") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VIGIL_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not checkpoint_dir(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vigil-ckpt-", dir="/tmp"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``, if any.

    Library code never picks a folder of its own; ``local_session`` does, for
    tests on one machine.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder and not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


_KEPT: list = []


def keep(df):
    """``df`` persisted in memory and on the executors' disks until ``release``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(df)
    return df


def release() -> None:
    """Unpersist every frame that the library keeps: call it once results that rest on them are written or cut."""
    while _KEPT:
        _KEPT.pop().unpersist()


def ship(spark: SparkSession) -> str:
    """Send this package to the executors of a cluster that does not have it installed; returns the archive sent."""
    import shutil
    from pathlib import Path
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="vigil-")) / package.name), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local).

    Without such a folder the frame is persisted in memory and on the executors'
    disks instead, and recomputed from its lineage if an executor is lost.
    """
    if checkpoint_dir(df.sparkSession):
        return df.checkpoint(eager=eager)
    return keep(df)
