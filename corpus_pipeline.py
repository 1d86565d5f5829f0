"""From documents to packed training sequences: quality, toxicity, near copies, packing.

Each stage works on all rows that its predecessor kept; between stages the rows are written as Parquet in
the shared folder and read again. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crownlake.llm.common import drop_stored, stored, table
from crownlake.llm.jaccard_join import one_of_each_group
from crownlake.llm.packing import pack, token_pieces
from crownlake.llm.queries import tokenizer_file
from crownlake.llm.rule_ensemble import fit_quality, keep_quality
from crownlake.llm.toxicity import drop_toxic, fit_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't find toxic."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    return one_of_each_group(docs, width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    return pack(token_pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("best-fit packing", packing),
]

#: Fitted models and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if n:
            drop_stored(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
