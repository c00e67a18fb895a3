"""Folders for streaming state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """An unused folder below spark.checkpoint.dir. Where that is unset a local session, as in
    tests, gets a temporary one; on a cluster it is an error."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not base:
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verdance-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
