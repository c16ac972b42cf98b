"""The corpus pipeline: five operators of ``shelfmark.llm`` in a row, from documents to packed sequences.

Each stage takes what the one before kept and gives documents with the same columns, the last one the pieces of the
sequences. Between stages the documents are written to the shared folder and read back, so a lost executor costs a
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import settled, ship, table
from shelfmark.llm.decontaminate import decontaminated
from shelfmark.llm.jaccard import one_of_each
from shelfmark.llm.lines import without_repeats
from shelfmark.llm.packing import packed, tokenizer_path
from shelfmark.llm.quality import accepted

# Near duplicates: shingles of five words, at least 80 hundredths in common.
SHINGLE = 5
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on the labels, does not reject."""
    ship(spark)
    return accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat an earlier one."""
    ship(spark)
    return without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the smallest doc_id."""
    ship(spark)
    return one_of_each(docs, SHINGLE, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item."""
    ship(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship(spark)
    return packed(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

# A fitted classifier, edit distance and a tokenizer are beyond SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
