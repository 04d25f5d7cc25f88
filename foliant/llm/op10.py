"""Query op10: a quality score for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .crf import QualityModel, labelled_sample, score_quality, train
from .op9 import held_out

#: Scores from here on count as label 1.
LEVEL = 0.7


def quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model of labels.quality from the documents that are not held out."""
    sample, prior = labelled_sample(docs, labels, ~held_out())
    return train([t for t, _ in sample], [y for _, y in sample], prior)


def op10_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= LEVEL).cast("int"))
