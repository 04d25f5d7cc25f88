"""Bounds of the Arrow batches that Python workers get."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def _number(value: str | None) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", value or "")
    return int(m[1]) * _UNITS.get(m[2].lower(), 1) if m else 0


def lower_batches(spark: SparkSession, rows: int, size: int) -> None:
    """Lower, and never raise, the session's bounds to so many rows and bytes: plans run
    later than they are made, and every one of them has to find bounds that hold for it."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = _number(spark.conf.get(key, None))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
