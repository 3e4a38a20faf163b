"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, mixture.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``, and so does the last, with each document as often as the mixture takes it.

Defined results: an empty table stays empty; a null text has no words, is scored as an empty text, is nobody's copy and
holds no passage; a null doc_id takes part in every stage (the mixture gives all null ids one place in its order); of rows
that agree in doc_id and text one stays where they are near-duplicates of anything, and all of them if they have no words;
extra columns, whatever their names, pass through every stage; of ties the smallest doc_id stays.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulselake.llm import decontaminate, minhash_dedup, mixing, quality, substring_dedup
from pulselake.llm.shared import documents, drop_tables, materialize, written_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the last stage wrote on its way; its own result is lazy and still reads these tables.
_BEFORE: list[str] = []


def stage(work: Stage) -> Stage:
    """``work`` as a stage: the tables of the stage before go first, unless the new stage's input reads them still
    (its result has been written and read again, as stages are run). Tables of a stage that fails go at once, and
    what operators outside of stages write is never touched."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        drop_tables(spark, [p for p in _BEFORE if not any(f"/{p.split('://')[-1].strip('/')}/" in f for f in read)])
        _BEFORE.clear()
        with written_tables() as own:
            try:
                out = work(spark, docs, sf_dir)
            except BaseException:
                drop_tables(spark, own)
                raise
        _BEFORE.extend(own)
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return minhash_dedup.keep_one(docs, k=5, percent=80)


@stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat 50 words or more of an earlier document go."""
    return substring_dedup.remove_repeats(docs)


@stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of the sources takes it."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
]

#: Classifier, near-duplicates and approximate matching are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for _, work in STAGES:
        lazy = work(spark, docs, sf_dir)
        with written_tables() as own:
            docs = materialize(lazy)
        drop_tables(spark, before)  # the input of a stage whose result is written
        before = own
    drop_tables(spark, _BEFORE)
    return docs
