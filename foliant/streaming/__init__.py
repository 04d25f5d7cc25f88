"""Folders of PDF files as streams. All tables of a collection are functions of one file at a
time, so they work on a stream as on a folder, without state or watermark."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.collection import Pdfs

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_pdfs(spark: SparkSession, path: str, password: str | bytes | None = None, mode: str = "PERMISSIVE", glob: str = "*.pdf", files_per_trigger: int = 1000) -> Pdfs:
    """Files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return Pdfs(files, password, mode)
