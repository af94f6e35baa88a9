"""Spark session settings and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED_DIR_CONF = "spark.checkpoint.dir"


def build_session(master: str, app: str = "tracewarden", partitions: int = 8) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root folder for written tables, read from the session.

    Only in a local session that names none (tests on one machine) a new temporary folder
    is made and set as the checkpoint folder.
    """
    root = spark.conf.get(SHARED_DIR_CONF, None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tracewarden-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tracewarden/{name}-{uuid.uuid4().hex}"
