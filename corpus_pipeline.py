"""A training corpus from raw documents: language ID, line dedup, near-duplicate removal, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import jaccard, langid, linededup, mixing, packing
from nearfield.llm.common import small_batches, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned from their labels.

    Null and empty texts and those without letters go, as do foreign ones; with no labelled row all go. Repeated rows go
    or stay alike; columns may have any name.
    """
    small_batches(spark)
    return langid.known_only(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go. n_chars is counted again.

    Null texts stay; rows equal in doc_id and text are one document; columns may have any name.
    """
    small_batches(spark)
    return linededup.cleaned(docs, length="n_chars")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the first by doc_id, null last, then by text.

    Texts without words (null and empty ones) all stay, but rows equal in doc_id and text are one; columns may have any
    name.
    """
    small_batches(spark)
    return jaccard.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix of sources, in training order, repeats included.

    Null and empty texts have no words to take and go; null source is a source; columns may have any name.
    """
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    Null text is empty, one piece of the end token; repeated rows are documents each; other columns don't matter.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pack", pack)]
#: The stages hash, train and tokenise; SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage but the last is written and read again. Empty documents, empty result."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
