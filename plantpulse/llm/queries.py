"""The operators as named queries over the shared tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantpulse.llm import (
    alignment, extraction, fingerprints, jaccard_join, languages, licences, manifest, neighbours, packing,
    personal, quality, token_counts, word_table,
)
from plantpulse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


def vocabulary(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op7_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query
def op10_word_table(spark, sf_dir):
    return word_table.encode_decode(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digests=True
    )


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query
def op1_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.grades(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op6_extraction(spark, sf_dir):
    return extraction.main_text(table(spark, sf_dir, "pages"))


@query
def op2_licences(spark, sf_dir):
    return licences.licences(table(spark, sf_dir, "documents"))


ORACLE["op2_licences"] = licences.oracle()


@query
def op4_neighbours(spark, sf_dir):
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op3_personal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return personal.personal_data(docs, personal.train(docs))


@query
def op13_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return manifest.proofs(docs, manifest.every_fifth(docs["doc_id"]))


ORACLE["op13_manifest"] = manifest.oracle()


@query
def op12_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return languages.languages(docs, languages.train(docs))


@query
def op11_alignment(spark, sf_dir):
    return alignment.alignments(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    )
