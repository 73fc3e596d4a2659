"""Session helpers: local sessions for tests and the bench, shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "riskengine") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir`` (or the context's directory).
    Only a local-mode session without one gets a fresh temporary folder.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- remote session: the configured folder is all we have
        if conf:
            return conf
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="riskengine-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


MATERIALISED_PREFIX = "riskengine-"


def clean_materialised(spark: SparkSession) -> int:
    """Delete the tables this package materialised in the checkpoint folder
    (dense indexes, CSV round trips, forest leaf exports). Call it after the
    results that read them have been consumed; returns the number removed."""
    root = checkpoint_dir(spark)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    removed = 0
    for status in fs.listStatus(path):
        p = status.getPath()
        if p.getName().startswith(MATERIALISED_PREFIX) or p.getName().startswith("forest-"):
            fs.delete(p, True)
            removed += 1
    return removed
