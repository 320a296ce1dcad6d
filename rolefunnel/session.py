"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the only runtime setting results depend on: timestamps are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, used to cut lineage and for stream state.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that setting
    is absent and the master is local a throw-away folder is made, once per
    session; a cluster without the setting is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="rolefunnel-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that it survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if folder not in (spark.sparkContext.getCheckpointDir() or ""):
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is written inside drops its shuffle files as soon as it is written, not when the driver happens to collect garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, "false")
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
