"""From documents to packed training sequences: five stages, each an operator of ``quillspark.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.  ``run`` writes each stage's result
as Parquet to the shared folder and reads it again, so that a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language, line_dedup, near_dedup, packing, suffix_dedup
from quillspark.llm.common import staged, table


def _with_text(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; n_chars, if there, is that of the text as it is now."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those below the calibrated score go, and texts that are null, empty or without letters."""
    return language.recognised(docs, language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines like earlier ones; documents that lose their last word go, null and empty texts stay as they are."""
    return _with_text(line_dedup.dedup_rows(docs), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each cluster of near-duplicates; texts without words are clusters of their own, equal rows one document."""
    return near_dedup.dedup(docs)


def dedup_suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier; signs that this cuts in two and emptied documents go.

    Null, empty and short texts stay as they are.
    """
    return _with_text(suffix_dedup.dedup_rows(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 1024 tokens; null and empty texts are one end sign."""
    return packing.pack_documents(docs, packing.rank_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("suffix_dedup", dedup_suffixes),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
