"""Spark session settings used by tests, the bench and the entry points.

On a cluster the session already exists; ``configure`` only fills in settings the
cluster left unset (checkpoint folder, AQE) and never overrides what is there.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# static settings: only for sessions built here (a running session keeps its own)
STATIC_DEFAULTS = {
    # call-site capture costs several JVM round trips per DataFrame / Column call while plans
    # are built; the verifier builds plans with thousands of expressions
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "migrata") -> SparkSession:
    """Local session for tests and benchmarks (UI off, AQE on)."""
    master = master or os.environ.get("MIGRATA_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MIGRATA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**STATIC_DEFAULTS, **DEFAULTS}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Fill unset settings (the checkpoint folder is looked up only where something is written)."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            try:
                spark.conf.set(k, v)
            except Exception:  # noqa: BLE001 - a setting the running session does not allow to change
                pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder from ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a scratch folder of its own; on a cluster a missing
    setting is an error, since executors do not see each other's local folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need storage that all executors share")
        d = tempfile.mkdtemp(prefix="migrata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
