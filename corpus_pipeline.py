"""The corpus pipeline: its stages in order, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written to the shared folder, so that a lost executor costs a reread and no stage runs twice.

SQL cannot express the first stage, a model fitted here, so there is no oracle; tests hold the stages to brute force.

Cases: stages keep a row's columns as they are, whatever their names; a null or empty text is not toxic, is no near copy and has no
benchmark passage, so it stays, has size 0 in the mix and the end id alone as tokens; rows that repeat a doc_id and a text count
as one from the second stage on; rows without a doc_id all stay there; without rows every stage gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.llm import decontam, minhash, mixing, tokens, toxicity
from assaylake.llm.common import written
from assaylake.llm.learn import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the random field scores below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(3, 1))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8."""
    return minhash.one_of_each(spark, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed(spark, docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in the content-addressed store, and what reading it back gives for each document."""
    return tokens.encode_and_verify(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, f"pipeline-{name}")
    return docs
