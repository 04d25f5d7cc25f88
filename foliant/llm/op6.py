"""Query op6: every document with pseudonyms for its personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pseudonyms import KINDS, pseudonymise

#: For tests and the check only; a real run takes a secret of its own.
KEY = "foliant-demonstration-key"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, KEY, count="found")
    return out.select("doc_id", "text", *[F.col("found")[k].cast("bigint").alias(f"n_{k}") for k in KINDS])
