"""Session settings shared by every entry point."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "tidemark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators rely on: UTC, AQE and dynamic overwrite."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


#: Temporary folders of sessions in local mode that have no spark.checkpoint.dir, by application id.
_OWN_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder that every executor sees: below spark.checkpoint.dir, or where that is unset below a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and every executor see")
        own = spark.sparkContext.applicationId
        if own not in _OWN_DIRS:
            _OWN_DIRS[own] = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        base = _OWN_DIRS[own]
    return f"{base.rstrip('/')}/tidemark/{kind}-{uuid.uuid4().hex}"
