"""From raw documents to packed sequences, one dealt operator per stage.

Rows with nulls, empty or repeated texts, extra columns and empty tables pass
as each operator's module says. A document without an id is judged by its text
but can neither be named as a copy nor packed under a number of its own: the
near-duplicate and passage stages leave it alone.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.llm import packing, quality, simhash, suffixes, toxicity
from loadweave.llm.common import free_name, prepared, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that policy v1 rejects go."""
    return quality.kept_documents(docs)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents with a score of 0.7 or more go."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "_toxicity")
    return toxicity.scored(docs, machine, column=score).where(F.col(score) < 0.7).drop(score)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group of three-word fingerprints linked at three or fewer bits the smallest id stays."""
    return simhash.one_per_group(docs, budget=3, width=3)


def keep_passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 50 words or more stay where they occur first."""
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left, in sequences of 4,096 tokens."""
    return packing.packed(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("toxicity", keep_harmless),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", keep_passages_once),
    ("best_fit_packing", pack),
]

#: Several stages learn, link or tokenise, which SQL cannot state; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written as Parquet and read again."""
    prepared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
