"""Query op7: every text of documents encoded and decoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_bpe
from .common import table

VOCABULARY = "word_bpe_49k.json"


def digests(ids: Column) -> list[Column]:
    return [F.floor(F.octet_length(ids) / 4).cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256")]


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(VOCABULARY)
    coded = encode_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", path, decoded="decoded")
    return coded.select("doc_id", *digests(coded["ids"]), F.sha2("decoded", 256).alias("decoded_sha256"))
