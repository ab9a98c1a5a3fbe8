"""A cleaning pipeline over ``documents``: toxicity, quality, line dedup, near-dedup, packing.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``; ``run`` writes each result to
the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originflow.llm import line_dedup as lines
from originflow.llm import packing, quality, simhash
from originflow.llm import toxicity as toxic
from originflow.llm.common import Staged, read_table

#: Rows of an Arrow batch. Texts are wide rows: at Spark's default of 10,000 a task holds tens of MB of them several times over, in
#: the JVM and in Python, and workers that are used again keep what they once took.
BATCH_ROWS = 1000

#: The stages work on text models, components and token ids, which SQL cannot state; ``tests/llm`` checks each stage.
ORACLE_SQL = None


def text_batches(spark: SparkSession) -> None:
    """Have the session hand texts to Python in small batches; a session with smaller ones keeps them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict as toxic."""
    text_batches(spark)
    model = toxic.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxic.score(docs, model).filter(F.col("predicted") == 0).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model predicts as good."""
    text_batches(spark)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter(F.col("predicted") == 1).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share; ``n_chars`` follows the text."""
    text_batches(spark)
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of near copies; rows with null or repeated ids are judged by their own text."""
    text_batches(spark)
    return simhash.representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    text_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


STAGES = [("toxicity", toxicity), ("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = Staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
