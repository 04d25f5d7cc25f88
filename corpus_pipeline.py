"""A training corpus from documents: filter, deduplicate, pseudonymise, mix, encode.

Each stage takes the documents that its predecessor kept and returns documents with
the same columns, the last one their token ids. Decisions take effect: documents
that the quality classifier rejects go, one document of each group of near copies
stays, personal data is replaced, and the mix repeats or leaves out documents.

Defined cases: null texts count as empty (quality, mix, ids) and stay null until then;
rows with the same id and text are one document, which stays or goes whole; null ids,
sources and languages are kept; an empty table gives no rows; columns that documents do
not have are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe import encode_bpe
from foliant.llm.common import materialise, table
from foliant.llm.crf import score_quality
from foliant.llm.mixing import mix_draws, mixed
from foliant.llm.op7 import VOCABULARY, digests
from foliant.llm.op10 import LEVEL, quality_model
from foliant.llm.order_minhash import near_texts
from foliant.llm.pseudonyms import pseudonymise

#: Setting with the secret that pseudonyms come from; Spark hides settings of such names.
SECRET = "spark.foliant.pseudonyms.secret"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, by a model of labels.quality, is LEVEL or more."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select(*COLUMNS), model, out="__score").where(F.col("__score") >= LEVEL).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id; null ids stay."""
    gone = near_texts(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data in their texts, under the secret of the
    session (SECRET); where there is none, under a new one that nobody keeps."""
    key = spark.conf.get(SECRET, None) or secrets.token_hex(32)
    return pseudonymise(docs.select(*COLUMNS), key).withColumn("n_chars", F.length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that a document is taken."""
    return mixed(mix_draws(docs.select(*COLUMNS), key=F.struct("doc_id")), COLUMNS).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (little-endian unsigned 32-bit integers), and digests of the ids and of the decoded text."""
    path = public_tokenizers.path(VOCABULARY)
    coded = encode_bpe(docs.select("doc_id", "source", "text"), "text", path, decoded="decoded")
    return coded.select("doc_id", "source", *digests(coded["ids"]), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("pseudonyms", pii),
    ("mix", mix),
    ("bpe", bpe),
]

#: Trained models and random draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
