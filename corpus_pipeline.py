"""Filters, deduplicates, mixes and packs the documents of a corpus, stage by stage.

All stages: a null text counts as empty; texts of any length are read whole; an empty table gives an
empty result; columns that a stage does not need stay as they are, whatever their names, and null
values in them are values like others. Identifiers, languages and sources may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import exact, jaccard, mixing, packing, toxicity
from fleetlens.llm.queries import vocabulary
from fleetlens.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Repeated rows are judged alike; empty texts stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays; of rows equal in both, one; empty texts are equal texts."""
    return exact.without_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.75 on five-word shingles hold together, the smallest doc_id stays.

    Documents without words are linked with nothing and stay; a null doc_id counts as the largest.
    """
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them; those without words are not part of it.

    A null source is a source of its own; repeated rows are mixed as rows of their own.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; a document without tokens is its end token, copies are packed each."""
    return packing.pack(docs, tokenizer=vocabulary("word_bpe_49k.json")).drop("loss_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# The toxicity model and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
