"""Query op1: every text of documents stored as TIFF and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tiff import EVERY, file_digests, store_tiff, tiff_pages


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of all kinds, chosen by each text; read page by page."""
    docs = table(spark, sf_dir, "documents")
    raw = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("payload"))
    stored = store_tiff(raw, "payload", layouts=EVERY)
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    head = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    read = file_digests(tiff_pages(stored, keep=head), head)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_pages", F.col("error").alias("tiff_error"))
