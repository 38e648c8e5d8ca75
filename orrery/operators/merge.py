"""Merges of tiers and sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import coherence


def preferred(tiers: list[DataFrame], key: list[str]) -> DataFrame:
    """Of each key the row of the first tier that has it, with its number in `tier`."""
    every = reduce(DataFrame.unionByName, (t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)))
    others = [c for c in every.columns if c not in (*key, "tier")]
    first = every.groupBy(*key).agg(F.min_by(F.struct("tier", *others), "tier").alias("_first"))
    return first.select(*key, *(F.col(f"_first.{c}").alias(c) for c in (*others, "tier")))


def merged_top_k(hot: DataFrame, cold: DataFrame, k: int) -> DataFrame:
    """Results (query_id, doc_id, distance) of two tiers: one row a document, the hot distance preferred, the best k."""
    best = preferred([hot.select("query_id", "doc_id", "distance"), cold.select("query_id", "doc_id", "distance")], ["query_id", "doc_id"]).where(~F.isnan("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def drain(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """What to do with each hot row at a flush: keep the cold one where both agree or differ, write it where cold has none."""
    c = cold.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"))
    action = F.when(F.col("_id").isNull(), "repair").when(F.col("_d") != F.col("digest"), "keep_cold_diverged").otherwise("keep_cold")
    return hot.join(c, F.col("doc_id") == F.col("_id"), "left").select("doc_id", action.alias("action"))


def first_of_equal(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with equal texts in `key` the first. Texts are compared by their SHA-256, so none is a key of a shuffle; each task sends on one row a text."""
    first = rows.groupBy(F.sha2(F.col(key).cast("string"), 256).alias("_digest")).agg(F.min_by(F.struct(*rows.columns), order).alias("_first"))
    return first.select("_first.*")


def new_segments(all_: DataFrame, backed_up: DataFrame, key: str = "segment") -> DataFrame:
    return all_.join(backed_up.select(key), key, "left_anti")


def by_precedence(tiers: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Each key's row of the first tier that holds it, with the tier's place; all tiers have the same columns."""
    return preferred(tiers, [key])


def hydrated(cache: DataFrame, hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Each canonical document with what serves it: the cache or else the hot tier where its copy is the canonical one, else cold.

    cache and hot: doc_id, version, digest, actual (the copy's own digest now); cold: doc_id, version, digest. A copy without a
    canonical document serves nothing.
    """
    good = lambda tier, name: coherence(tier, cold).where("status = 'match'").select(F.col("doc_id").alias(f"_{name}")).distinct()
    out = cold.select("doc_id").join(good(cache, "cache"), F.col("doc_id") == F.col("_cache"), "left").join(good(hot, "hot"), F.col("doc_id") == F.col("_hot"), "left")
    return out.select("doc_id", F.when(F.col("_cache").isNotNull(), "cache").when(F.col("_hot").isNotNull(), "hot").otherwise("cold").alias("served"))


def query_pools(pairs: DataFrame, most: int) -> DataFrame:
    """pairs: doc_id, query_id: (doc_id, place, query_id), the first `most` queries of each document, places from 0.

    A document's queries are dealt to parts, of each of which the first `most` go on, so no task ranks them all.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("query_id")) - 1
    few = pairs.select("doc_id", "query_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(64))).withColumn("place", place("doc_id", "_part")).where(F.col("place") < most)
    return few.withColumn("place", place("doc_id")).where(F.col("place") < most).select("doc_id", "place", "query_id")
