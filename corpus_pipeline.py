"""A pipeline over the documents: grades, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
result as Parquet to the shared folder and reads it again as the next one's
input, so a lost executor never costs more than its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plantpulse.llm import jaccard_join, packing, personal, quality
from plantpulse.llm.common import table
from plantpulse.llm.queries import vocabulary
from plantpulse.operators.durable import fresh_folder

#: Words a worker remembers in the last stage.
REMEMBERED = 500_000


def grade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected rating is not of low quality, by a model fitted on the rated ones."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, words=5, num=80, den=100)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return personal.redacted(docs, personal.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, one row for each piece of a document.

    The heap of an executor has grown over the stages before, so workers remember fewer words.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [("quality", grade), ("near_copies", one_of_each), ("personal_data", redact), ("packing", pack)]
#: Trained models and a tokenizer are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
