"""A corpus pipeline of five stages, each an operator of chronoloom.llm: language ID, n-gram Jaccard join, substring dedup, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import langid, mixing, packing, partenum, substring
from chronoloom.llm.common import documents, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go; rows that repeat are judged alike, and null ids, sources and languages stay as they are.  An empty table stays empty."""
    return langid.identify(docs).filter("lang_pred <> 'und'").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard of five-word shingles from 0.8) the document with the smallest doc_id stays.

    A null doc_id is greater than all; of rows equal in doc_id the least hash of the text stays, of rows equal in both one.  Rows without words are groups of their own and stay.
    """
    return partenum.kept(docs, share=80, n=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; documents of which no word is left go (those without a text or a word too).  Rows that repeat, null ids among them, count as elsewhere for each other."""
    cut = substring.remove(docs).filter("n_words > n_removed")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come near their targets; a null source is one too, rows equal in doc_id and text are taken alike, ties go by doc_id and size."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences; a null text is its end token alone, and rows that repeat are packed each."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if i < len(STAGES) - 1:
            out = stored(out, name)
    return out
