"""Query op9: the language of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import detect_language, train, training_sample

#: Labelled texts taken for training, for each language: at most so many, and none after so many bytes.
PER_LANGUAGE, LANGUAGE_BYTES = 500, 4 << 20


def held_out() -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = training_sample(docs.where(~held_out()), "text", "lang", PER_LANGUAGE, LANGUAGE_BYTES)
    model = train([t for _, t, _ in sample], [y for _, _, y in sample])
    return detect_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
