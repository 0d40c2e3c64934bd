"""Session helpers: the engine never builds its own cluster config beyond
what a test or bench needs, and reads shared settings from the session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "mailfeat") -> SparkSession:
    """Local session for tests and bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Where it is unset, a local session (tests) gets a scratch folder; a
    cluster must name one, as its executors share no local disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="mailfeat-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def ship_package(spark: SparkSession) -> str:
    """Send this package to the Python workers of a cluster where it isn't installed; returns the archive's path."""
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="mailfeat-ship-")) / "mailfeat"
    archive = shutil.make_archive(str(base), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive
