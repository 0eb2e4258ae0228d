"""The training-data pipeline over ``documents``: language, lines, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landstrata.llm import decontaminate, langid, line_dedup, packing, simhash
from landstrata.llm.common import recorded, remove, table, written
from landstrata.llm.queries import tokenizer


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, and null texts, go. The model learns from the labelled rows of ``docs``."""
    known = langid.predict(docs, langid.fit(docs), docs.columns)
    return known.where("lang_pred <> 'und'").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one up to two edits."""
    return line_dedup.without_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item occur."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), length=10)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2,048 tokens. Workers remember less here, as they live on beside other stages."""
    return packing.pack_documents(docs, tokenizer(), end_id=0, capacity=2048, remembered=300_000)


_LEFT: list[str] = []  # scratch folders of the stage that ran last


def _tidy(first: bool, stage):
    """``stage``, which first removes the scratch tables of the stage before it: their result is written and reread as its ``docs``."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not first:
            remove(spark, _LEFT)
        _LEFT.clear()
        with recorded(_LEFT):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _tidy(True, language_id)), ("line_dedup", _tidy(False, dedup_lines)), ("simhash_dedup", _tidy(False, dedup_documents)),
    ("decontamination", _tidy(False, remove_contaminated)), ("packing", _tidy(False, pack)),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            with recorded(now := []):
                docs = written(docs, name)
            remove(spark, kept)
            kept = now
    return docs
