"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

Quality classifier, n-gram Jaccard join, benchmark decontamination, source mixture, token files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywick.llm import decontaminate, mixture, ngram_join, ordinal_quality
from tallywick.llm import queries as corpus
from tallywick.session import Scratch, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the grade `good` reaches one half.

    The classifier is fitted on the rated documents that are among docs.
    """
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"), ordinal_quality.rated_grade())
    return ordinal_quality.selected(docs, model, grade=corpus.GOOD, min_tail=corpus.MIN_TAIL)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one whose id names the class.

    Rows are told apart by id and text: rows that share an id but not a text are documents of their own.
    """
    return ngram_join.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item's tiles cover to half or more."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by raked and calibrated probabilities."""
    return mixture.drawn(docs, corpus.mixture_dims(), mixture.word_count(), keep_share=corpus.KEEP_SHARE)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in the range-coded token files, read back from them."""
    return corpus.token_files(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixture", mixed_sources),
    ("token_binary", token_files),
]

#: The stages train, compare and code beyond what SQL can express; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every result is a table that the next stage reads."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
