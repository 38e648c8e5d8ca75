"""Connected components by alternating large and small stars, one join and one aggregate to each half round.

A node with very many links is never gathered: its least neighbour comes from a partial aggregate, and the
join that sends it out is a plain equi-join, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store as S


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u > v. Links each neighbour of u to the least of them all."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, home: str, most_rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (node, root): root is the least node that links reach. Nodes without links are absent."""
    edges = S.saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{home}/cc0")
    before = None
    for k in range(1, most_rounds + 1):
        edges = S.saved(_star(_star(edges, True), False), f"{home}/cc{k}")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        S.drop(edges.sparkSession, f"{home}/cc{k - 1}")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
