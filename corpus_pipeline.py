"""A corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next
one's docs. All but the last return the columns of docs, in their order and with their types; a column of any name
other than doc_id and text passes through untouched, also one named like a column that an operator adds.

Nulls and edges, of every stage: an empty table gives an empty one; a null text counts as empty; rows with one doc_id
are one document for near duplicates, which stay or go together, and are judged each alone elsewhere; a row without
doc_id is never dropped as a copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import _store, decontam, jaccard_join, line_dedup, packing, quality

LEAST_QUALITY = 0.3
#: Words of a benchmark window. A document with one is dropped, however long it is.
WINDOW = 13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keep: Column | None = None) -> DataFrame:
    """operator(docs) where `keep` holds, with the columns of docs; those but doc_id and text travel in one struct, out of the way."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    name = "_" + "_".join(["rest", *rest])  # no operator's name, no column's name
    held = [F.struct(*(docs[c] for c in rest)).alias(name)] if rest else []
    out = operator(docs.select("doc_id", "text", *held))
    out = out if keep is None else out.where(keep)
    return out.select(*(F.col(c) if c in ("doc_id", "text") else F.col(name)[c].alias(c) for c in docs.columns))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted to the labelled ones, doesn't reject; without labels all stay."""
    model = quality.train(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"), F.lit(False))
    return _apart(docs, lambda d: quality.scored(d, model), F.col("score") >= LEAST_QUALITY)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one with the largest doc_id only; n_chars, if there, follows the text."""
    out = _apart(docs, line_dedup.without_repeats)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the least doc_id stays."""
    named = jaccard_join.classes(docs.select("doc_id", "text"), words=5, num=8, den=10)
    gone = named.where("doc_id is not null AND doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole window of a benchmark item, and without a notable share of words from shorter items."""
    clean = ~F.col("contaminated") & (F.col("n_hit") < WINDOW)
    return _apart(docs, lambda d: decontam.contamination(d, _table(spark, sf_dir, "benchmark"), width=WINDOW), clean)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece of a document, under the columns of the packing operator."""
    return packing.packed(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("repeated_lines", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("pack", pack),
]

#: A fitted model, set similarity and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    home = _store.workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with _store.owned(spark):
            docs = _store.saved(stage(spark, docs, sf_dir), f"{home}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
