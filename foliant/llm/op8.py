"""Query op8: the mix of all documents, counted back for each document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .mixing import counted_back, mix_draws, mixed

#: What tells rows of documents apart here; rows alike in it are alike, and taken alike.
ROW = ["doc_id", "text_hash", "size", "source_size", "target"]


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are counted in the rows of the mix itself, which carry no texts here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    drawn = mix_draws(docs, key=F.struct("doc_id")).select("doc_id", F.xxhash64("text").alias("text_hash"), "size", "source_size", "target", "draws")
    drawn = materialise(drawn, "draws")
    back = counted_back(drawn, mixed(drawn, ROW), ROW)
    return back.select("doc_id", "size", "source_size", "target", "taken", "shards")
