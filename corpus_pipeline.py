"""The corpus pipeline: documents in, packed sequences out.

Each stage takes the rows that the stage before it kept, as a table in the shared folder,
and returns all columns of ``documents`` but the last one, which returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsight.llm import jaccard, language, linededup, packing, toxicity
from opsight.llm.common import fold, table, written

#: A document whose language is less certain than this is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.05


def _learnable(folds: int, held_out: int) -> Column:
    return F.coalesce(fold("doc_id", folds) != held_out, F.lit(False))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language."""
    model = language.train(table(spark, sf_dir, "documents"), _learnable(4, 2))
    found = language.identify(docs, model)
    kept = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop toxic documents."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(table(spark, sf_dir, "documents"), labels, _learnable(5, 0))
    graded = toxicity.severity(docs, model)
    return graded.filter(F.col("toxic_probability") < toxicity.TOXIC_FROM).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that other documents hold; documents keep their rows, even if empty."""
    cut = linededup.without_dropped(docs, linededup.keep_bitmaps(docs))
    return cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near copies (five words, 0.8 or more)."""
    found = jaccard.components(docs, words=5, percent=80)
    gone = found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack_sequences),
]

#: The learned stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


REGISTRY = {"pipeline": (run, ORACLE_SQL)}
