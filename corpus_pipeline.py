"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality rules, then one document of each near-duplicate group, then repeated byte strings, then the mix, then packing. Each stage works on
all rows that its predecessor kept; all but the last return the columns of documents. An empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from framewright.llm.common import documents, made, remove_made, written
from framewright.llm.mixing import mixed_documents
from framewright.llm.packing import pack_documents
from framewright.llm.quality import fit_quality, kept_documents
from framewright.llm.similar import without_similar
from framewright.llm.suffixes import without_repeats
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the forest reject go. A null or empty text has no words and goes; repeated rows are judged alike; very long texts are counted whole."""
    return kept_documents(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more. Null and empty texts are one group; of repeated rows one stays; texts of any length are compared whole."""
    return without_similar(docs, width=5, similarity=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each 50-byte string stays only in the document of the smallest id. A null text stays null, an empty one empty; rows of one id don't take from each other; very long texts are one document like any other."""
    return without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to target weights, whole epochs first; null is a source of its own; a text without words comes as often as its source's whole epochs; a very long text may be cut to its first words."""
    return mixed_documents(docs, [3, 1, 2])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows. A null text is just the end id; repeated rows are packed once each; a very long text fills windows of its own."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", suffix_dedup), ("mixing sources to target weights", mixing), ("packing", packing)]
#: The forest of the first stage, the fingerprints of the second and the token ids of the last are nothing that SQL has.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's intermediate tables go when its result is written, its result when the next one is."""
    docs, first = documents(spark, sf_dir), made()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
        remove_made(spark, made() - 1, first)
    return STAGES[-1][1](spark, docs, sf_dir)
