"""Access logs to try caches on, made by DataFrame functions: equal arguments give equal logs on any number of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def point(at: Column, seed: int, salt: int) -> Column:
    """A number in [0, 1) that a position, a seed and a salt decide."""
    return F.shiftrightunsigned(F.xxhash64(at, F.lit(seed), F.lit(salt)), 11) / float(1 << 53)


def zipf(x: Column, docs: int, exponent: float) -> Column:
    """An id below `docs` by the inverse of the continuous Zipf distribution at x: the lower the id, the more frequent."""
    if exponent == 1.0:
        rank = F.exp(x * F.log(F.lit(float(docs + 1))))
    else:
        top = (docs + 1) ** (1 - exponent)
        rank = F.pow(1 + x * (top - 1), F.lit(1 / (1 - exponent)))
    return F.least(F.floor(rank) - 1, F.lit(docs - 1)).cast("long")


def accesses(spark: SparkSession, n: int, docs: int, *, exponent: float = 1.2, seed: int = 0, cold: float = 0.0, spike: tuple[int, int, int] | None = None, every: int | None = None) -> DataFrame:
    """(pos, doc_id): n accesses of Zipf-distributed documents.

    cold: this share goes to any document alike. spike (from, to, document): half of the accesses at these positions go to one
    document. every: after so many accesses the hot documents are others: ids are turned by an eighth of the documents.
    """
    pos = F.col("pos")
    doc = zipf(point(pos, seed, 1), docs, exponent)
    if every is not None:
        doc = (doc + F.floor(pos / every) * max(1, docs // 8)) % docs
    if cold > 0:
        doc = F.when(point(pos, seed, 2) < cold, F.floor(point(pos, seed, 3) * docs)).otherwise(doc)
    if spike is not None:
        doc = F.when(pos.between(spike[0], spike[1] - 1) & (point(pos, seed, 4) < 0.5), F.lit(spike[2])).otherwise(doc)
    return spark.range(n).withColumnRenamed("id", "pos").select("pos", doc.cast("long").alias("doc_id"))


def paraphrases(log: DataFrame, pools: DataFrame, *, sticky: float = 0.7, seed: int = 0) -> DataFrame:
    """log (pos, doc_id) with query_id: a query of the document's pool, the pool's first one for the share `sticky` of the accesses, else any.

    pools: doc_id, place, query_id, places from 0 without gaps. Documents without a pool get null.
    """
    size = pools.groupBy("doc_id").agg(F.max("place").alias("_last")).withColumnRenamed("doc_id", "_doc")
    asked = log.join(size, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    place = F.when(point(F.col("pos"), seed, 5) < sticky, 0).otherwise(F.floor(point(F.col("pos"), seed, 6) * (F.col("_last") + 1)))
    asked = asked.withColumn("_place", place.cast("long")).drop("_last")
    of = pools.select(F.col("doc_id").alias("_doc"), F.col("place").cast("long").alias("_at"), "query_id")
    return asked.join(of, (F.col("doc_id") == F.col("_doc")) & (F.col("_place") == F.col("_at")), "left").select("pos", "doc_id", "query_id")
