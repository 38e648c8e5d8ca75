"""Ranking quality: DCG, NDCG, MRR, recall. Rows: query_id, doc_id, position (from 0), relevance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _by():
    return Window.partitionBy("query_id")



def _gain(place: Column) -> Column:
    return F.col("relevance") / F.log2(place + 2)


def dcg(results: DataFrame, k: int) -> DataFrame:
    """(query_id, dcg, idcg, ndcg) over the first k entries of each list; ndcg is 0 where the ideal is."""
    listed = F.row_number().over(_by().orderBy("position", "doc_id")) - 1
    ideal = F.row_number().over(_by().orderBy(F.col("relevance").desc(), "doc_id")) - 1
    sums = results.withColumn("_p", listed).withColumn("_i", ideal).groupBy("query_id").agg(F.sum(F.when(F.col("_p") < k, _gain(F.col("_p"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("_i") < k, _gain(F.col("_i"))).otherwise(0.0)).alias("idcg"))
    return sums.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0))


def mrr(results: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("relevance") > 0, F.col("position")))
    return results.groupBy("query_id").agg(F.coalesce(1.0 / (first + 1), F.lit(0.0)).alias("mrr"))


def recall(results: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """totals: query_id, total relevant documents."""
    hits = results.groupBy("query_id").agg(F.count_if((F.col("position") < k) & (F.col("relevance") > 0)).alias("hits"))
    return hits.join(totals, "query_id").withColumn("recall", F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0))


def mean_ndcg(results: DataFrame, k: int) -> DataFrame:
    return dcg(results, k).agg(F.avg("ndcg").alias("mean_ndcg"), F.count("*").alias("queries"))


def predictor_quality(scores: DataFrame, k: int = 10) -> DataFrame:
    """scores: doc_id, admission, accesses: one row with ndcg, mrr and recall of the order by admission.

    The gain is the number of accesses; for mrr and recall the k most accessed documents are the relevant ones. Only
    k rows of each order are gathered; the place of the first relevant one is a count.
    """
    by_score = [F.col("admission").desc(), F.col("accesses").desc(), F.col("doc_id")]
    listed = scores.select("doc_id", "admission", "accesses").orderBy(*by_score).limit(k).collect()
    truth = scores.select("doc_id", "admission", "accesses").orderBy(F.col("accesses").desc(), "doc_id").limit(k).collect()
    gain = lambda rows: sum(r.accesses / math.log2(i + 2) for i, r in enumerate(rows))
    if not truth or not gain(truth):
        return scores.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "ndcg double, mrr double, recall double")
    best = min(truth, key=lambda r: (-r.admission, -r.accesses, r.doc_id))
    a, n, d = F.col("admission"), F.col("accesses"), F.col("doc_id")
    ahead = (a > best.admission) | ((a == best.admission) & ((n > best.accesses) | ((n == best.accesses) & (d < best.doc_id))))
    found = len({r.doc_id for r in truth} & {r.doc_id for r in listed})
    return scores.agg(F.lit(gain(listed) / gain(truth)).alias("ndcg"), (1.0 / (1 + F.count_if(ahead))).alias("mrr"), F.lit(found / len(truth)).alias("recall"))
