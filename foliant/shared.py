"""The folder that all machines of a cluster share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a temporary folder for a session on
    this machine alone, as in tests; an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "foliant-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
