"""Session helpers: a configured SparkSession and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one tuned for this library.

    On a cluster the session already exists and its settings win; the
    defaults here only matter for local runs and tests.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder
        .master(master or f"local[{cpus}]")
        .appName("actuaria")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ACTUARIA_DRIVER_MEMORY", "4g"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is.  Only when
    it is unset (local runs, tests) is a fresh private folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(intermediate tables and checkpoints are written there)")
        configured = tempfile.mkdtemp(prefix="actuaria-ckpt-")  # local runs and tests only
    elif configured.startswith("file:") and not sc.master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is local to each machine: {configured}")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SCRATCH: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this driver made so far (results read from them must be consumed before);
    returns how many there were."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    made, _SCRATCH[:] = list(_SCRATCH), []
    for path in made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    return len(made)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path
