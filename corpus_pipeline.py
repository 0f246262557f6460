"""From documents to token ids: quality rules, near-duplicates, personal data, a mix of sources, SentencePiece.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the next stage's documents, the
last one token ids.  `run` writes each stage's rows to the folder that the cluster shares and reads them again, and deletes the stage's before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import line_crf, mixing, pii, sentencepieces, simhash
from codeloom.llm.common import discard, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the field's verdict keep.  The field is fitted on labelled rows of docs."""
    return line_crf.kept_rows(docs, line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document.  Fewer words are remembered, as executors hold what earlier stages left."""
    return sentencepieces.encoded(docs, remembered=400_000)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mix of sources", mix), ("token ids", tokens)]
#: SQL can't express the conditional random field of the first stage, nor the stages after it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)  # the table itself stays
    return docs
