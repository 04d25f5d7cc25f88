"""Query op4: all documents as token files, read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .token_files import read_token_files, write_token_files


def op4_simple8b(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
