"""From raw documents to packed training windows: reject junk, reject toxic texts, keep one of
each group of copies, blank out secrets, pack.

Every stage works on all documents that the one before kept. The two classifiers are fitted on
the labelled documents of the data folder, whatever the stage is given. An empty table gives
empty results; what each stage does with nulls, repeated rows and the like its operator says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom import session
from factloom.llm import minhash, packing, quality, secret_scan, toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, with all their columns.

    Null texts go; empty ones go or stay by the model's bias. Repeated rows all go or all stay. An
    empty table gives an empty one, and extra columns stay, whatever their names.
    """
    model = quality.fit_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic, with all their columns.

    Null and empty texts stay; a score that equals the threshold is toxic; a null language has the
    threshold of all. Repeated rows all go or all stay. An empty table gives an empty one, and
    extra columns stay, whatever their names.
    """
    model = toxicity.fit_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, with all its columns: that of the least
    doc_id, null being the largest.

    Null texts all stay; empty ones are copies of each other; of repeated rows one stays. An empty
    table gives an empty one, and extra columns stay, whatever their names.
    """
    return minhash.keep_one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by marks, and n_chars to match.

    Null texts stay null and keep their number; empty texts and repeated rows stay. An empty table
    gives an empty one, and extra columns stay, whatever their names.
    """
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of one number of tokens, cut from the documents one after the other.

    Null and empty texts add nothing; a null doc_id comes first, documents of one doc_id in the
    order of a hash of their tokens, and repeated rows are packed each. An empty table gives no
    window; extra columns are left aside, whatever their names.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]
#: Two of the stages are trained models, which SQL can't express; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of sf_dir; each stage but the last is written to
    the shared folder and read again."""
    docs = _read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, session.written(stage(spark, docs, sf_dir), name)
        if i:
            session.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
