"""Exact k nearest neighbours of a set of queries.

The corpus is never shuffled: each task compares its rows with a block of queries by array arithmetic and
keeps k for each query, so the one shuffle carries k rows for each task and query. Queries go out in blocks of
a bounded size; more queries than one block are more passes over the corpus, in one plan. A task compares tiles of a batch
and a block, of HELD distances each, so its working memory grows neither with the queries nor with the batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import EPS, UNIT_HIGH, UNIT_LOW, score
from .filters import Always, compiled, search_width

METRICS = ("cosine", "euclidean", "inner_product")
MOST_K, MOST_QUERIES, BLOCK = 10_000, 100_000, 4_096
#: Distances or components that are worked on at once.
HELD = 1 << 20


def check(k: int, metric: str) -> None:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be from 1 to {MOST_K}, not {k}")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")


def tiles(n: int, each: int) -> Iterator[slice]:
    """All of n rows with `each` numbers a row, in pieces of at most HELD numbers, or one row."""
    step = max(1, HELD // max(1, each))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def matrix(col: pa.Array) -> np.ndarray:
    width = len(col[0]) if len(col) else 0
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != width * len(col):
        raise ValueError("vectors of different length")
    return flat.reshape(len(col), width)


def vectors(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a column that have this length and only finite components, and their places; others are left out."""
    n = np.array(pc.fill_null(pc.list_value_length(col), -1))
    ok = np.flatnonzero(n == width)
    flat = col.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), width)
    whole = np.isfinite(flat).all(1)
    return flat[whole], ok[whole]


def rows(col: pa.Array, width: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """As vectors(), of unit length for all metrics but the Euclidean one, for which zero vectors stay too."""
    x, at = vectors(col, width)
    if metric == "euclidean":
        return x, at
    ok = (x * x).sum(1) > EPS
    return unit(x[ok]), at[ok]


def unit(x: np.ndarray) -> np.ndarray:
    n2 = (x * x).sum(1)
    if (n2 <= EPS).any():
        raise ValueError("zero vector")
    return x / np.where((n2 >= UNIT_LOW) & (n2 <= UNIT_HIGH), 1.0, np.sqrt(n2))[:, None]


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        d = np.empty((len(q), len(x)))
        for row, one in zip(d, q, strict=True):
            row[:] = np.sqrt(((x - one) ** 2).sum(1))
        return d
    d = q @ x.T
    return np.maximum(0.0, np.subtract(1.0, d, out=d), out=d)


def _asked(queries: DataFrame, metric: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The queries on the driver, their ids and vectors; a number above the bound is an error."""
    asked = queries.limit(MOST_QUERIES + 1).toArrow()
    if asked.num_rows > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries in one call: search in several")
    asked = asked.combine_chunks()
    ids = asked.column("query_id").to_numpy()
    vectors = matrix(asked.column("embedding").combine_chunks()) if len(ids) else np.zeros((0, 0))
    return asked, ids, unit(vectors) if metric != "euclidean" and len(ids) else vectors


def knn(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", *, where=None, min_score: float = 0.0, keep: tuple[str, ...] = (), skip_self: bool = False, cells: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, distance, score, *keep) by rising distance, then doc_id.

    corpus: doc_id, embedding, and metadata where a filter is given; queries: query_id, embedding. The filter comes
    before the ranking, so k rows are found where there are k. min_score counts only above 0. Rows of the corpus whose vector is
    null, of another length, not finite or (but for the Euclidean metric) zero are passed over; such a query is an error.
    cells: centres, and of how many nearest ones each query sees the rows; all where none are given.
    """
    check(k, metric)
    if where is not None and not isinstance(where, Always):
        corpus = corpus.where(compiled(where, F.col("metadata")))
    corpus = corpus.select("doc_id", "embedding", *keep)
    asked, ids, vectors = _asked(queries.select("query_id", "embedding"), metric)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("distance", T.DoubleType()), *(corpus.schema[c] for c in keep)])

    def nearest_rows(d: np.ndarray, of: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in d of k distances for each query."""
        found, at = [], []
        for i, row in enumerate(d):
            ok = np.flatnonzero(np.isfinite(row) & ((docs != of[i]) | (not skip_self)))
            if len(ok) > k:  # all that tie with the k-th stay for the order by id
                ok = ok[row[ok] <= np.partition(row[ok], k - 1)[k - 1]]
                ok = ok[np.lexsort((docs[ok], row[ok]))[:k]]
            found.append(np.full(len(ok), i))
            at.append(ok)
        return np.concatenate(found), np.concatenate(at)

    def part(of: np.ndarray, block: np.ndarray):
        def f(batches):
            looked = None
            for b in batches:
                for piece in tiles(b.num_rows if len(of) else 0, block.shape[1]):
                    x, fit = rows(b.column("embedding")[piece], block.shape[1], metric)
                    if not len(fit):
                        continue
                    held = b[piece].take(pa.array(fit))
                    docs = held.column("doc_id").to_numpy()
                    if cells is not None:
                        groups, looked = grouped(x, cells[0]), probed(block, *cells) if looked is None else looked
                    for tile in tiles(len(of), len(x)):
                        d = distances(block[tile], x, metric) if looked is None else within_cells(block[tile], looked[tile], x, groups, metric)
                        found, at = nearest_rows(np.round(d, 12, out=d), of[tile], docs)
                        take = pa.array(at)
                        yield pa.RecordBatch.from_arrays([pa.array(of[tile][found]), held.column("doc_id").take(take), pa.array(d[found, at]), *(held.column(c).take(take) for c in keep)], schema.names)

        return f

    blocks = [corpus.mapInArrow(part(ids[i : i + BLOCK], vectors[i : i + BLOCK]), schema) for i in range(0, max(1, len(ids)), BLOCK)]
    found = reduce(DataFrame.unionByName, blocks).withColumn("score", score(F.col("distance"), metric))
    if min_score > 0:
        found = found.where(F.col("score") >= min_score)
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "distance", "score", *keep)


def knn_post_filter(corpus: DataFrame, queries: DataFrame, k: int, where, metric: str = "cosine", *, namespace: str | None = None) -> DataFrame:
    """As a server that ranks first: the best k times a factor, then the filter. May give fewer than k rows.

    total_found: candidates that the filter keeps, before the cut to k.
    """
    wide = knn(corpus, queries, search_width(k, where, namespace is not None), metric, keep=("metadata", "namespace"))
    kept = wide.where(compiled(where, F.col("metadata")))
    if namespace is not None:
        kept = kept.where(F.col("namespace") == namespace)
    by = Window.partitionBy("query_id")
    kept = kept.withColumn("total_found", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("distance", "doc_id")))
    return kept.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "distance", "score", "total_found")


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centres of each row by rising distance."""
    return np.argsort(distances(centres, x, "euclidean"), 0, kind="stable").T


def cell_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    own = np.zeros(len(x), np.int64)
    for t in tiles(len(x), len(centres)):
        own[t] = distances(centres, x[t], "euclidean").argmin(0)
    return own


def probed(q: np.ndarray, centres: np.ndarray, probe: int) -> np.ndarray:
    """For each query and cell, whether the cell is one of the query's nearest."""
    looked = np.zeros((len(q), len(centres)), bool)
    for t in tiles(len(q), len(centres)):
        np.put_along_axis(looked[t], nearest(q[t], centres)[:, :probe], True, 1)
    return looked


def grouped(x: np.ndarray, centres: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The cells that have rows, and the places of these."""
    own = cell_of(x, centres)
    return [(c, np.flatnonzero(own == c)) for c in np.unique(own)]


def within_cells(q: np.ndarray, looked: np.ndarray, x: np.ndarray, groups: list[tuple[int, np.ndarray]], metric: str) -> np.ndarray:
    """Distances as by distances(), infinite where a query doesn't look into a row's cell; those aren't computed."""
    d = np.full((len(q), len(x)), np.inf)
    for c, rows in groups:
        some = np.flatnonzero(looked[:, c])
        d[np.ix_(some, rows)] = distances(q[some], x[rows], metric)
    return d


def probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int, metric: str, tried: int = 1_000) -> int:
    """How many nearest cells hold the share `recall` of the k nearest other rows in the mean of `asked` queries, less two standard errors.

    Measured on the first `tried` rows of the sample against the whole sample; neighbours in all rows are nearer, so they are lost less often.
    """
    k, own = min(k, len(x) - 1), cell_of(x, centres)
    if k < 1:
        return len(centres)
    held = []
    for at in range(0, min(tried, len(x)), 100):
        q = x[at : at + 100]
        d = distances(q, x, metric)
        d[np.arange(len(q)), np.arange(at, at + len(q))] = np.inf
        near = np.argpartition(d, k - 1, 1)[:, :k]
        place = np.argsort(nearest(q, centres), 1)  # of each cell, by distance
        needed = np.take_along_axis(place, own[near], 1)
        held.append(np.stack([(needed < n).mean(1) for n in range(1, len(centres) + 1)], 1))
    share = np.concatenate(held)
    low = share.mean(0) - 2 * share.std(0) / math.sqrt(max(1, min(asked, len(share))))
    return int(np.argmax(low >= recall)) + 1 if (low >= recall).any() else len(centres)


def ivf(corpus: DataFrame, queries: DataFrame, k: int, *, cells: int | None = None, candidates: int | None = None, sample: int = 10_000, metric: str = "cosine", recall: float = 0.9) -> DataFrame:
    """Approximate search: rows by the nearest of `cells` centres (by default a quarter of the root of the rows, 16 to 1,024),
    fitted to a bounded sample; each query looks into as many nearest cells as hold the candidates that effort() asks for, and into
    as many more as the sample needs for a mean recall of `recall`. All rows are indexed; recall is measured against knn."""
    check(k, metric)
    total = corpus.count()
    cells = max(16, min(1024, math.isqrt(total) // 4)) if cells is None else cells
    fit = corpus.select("doc_id", "embedding").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toArrow().combine_chunks()
    if not fit.num_rows:
        return knn(corpus, queries, k, metric)
    col = fit.column("embedding").combine_chunks()
    width = int(np.bincount([n for n in pc.list_value_length(col).to_pylist() if n] or [0]).argmax())
    x, _ = rows(col, width, metric)
    if not len(x):
        return knn(corpus, queries, k, metric)
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(10):
        near = cell_of(x, centres)
        centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    held = -(-effort(k, total, candidates) * len(centres) // max(1, total))  # cells of the mean size with so many rows
    probe = max(min(held, len(centres)), probes(x, centres, k, recall, queries.count(), metric))
    return knn(corpus, queries, k, metric, cells=(centres, probe))


def threshold_counts(corpus: DataFrame, queries: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, same, hits, pairs): all pairs of a query and another row, by equal and different labels, and how many reach each cosine.

    corpus: doc_id, embedding, label; queries: query_id, embedding, label. Each task counts what it reads, so
    no pair leaves it.
    """
    asked, ids, vectors = _asked(queries.select("query_id", "embedding", "label"), "cosine")
    labels = asked.column("label").to_numpy()

    def part(of: np.ndarray, own: np.ndarray, block: np.ndarray):
        def f(batches):
            hits, pairs, seen = np.zeros((2, len(thresholds)), np.int64), np.zeros(2, np.int64), False
            for b in batches:
                for start in range(0, b.num_rows if len(of) else 0, 1024):
                    part_, seen = b.slice(start, 1024), True
                    x, fit = rows(part_.column("embedding"), block.shape[1], "cosine")
                    part_ = part_.take(pa.array(fit))
                    docs, labelled = part_.column("doc_id").to_numpy(), part_.column("label").to_numpy()
                    for tile in tiles(len(of), 1024):
                        cos = 1.0 - np.round(distances(block[tile], x, "cosine"), 12)
                        other, same = of[tile, None] != docs, own[tile, None] == labelled
                        for s, pick in enumerate((other & ~same, other & same)):
                            some = cos[pick]
                            pairs[s] += len(some)
                            hits[s] += [int((some >= t).sum()) for t in thresholds]
            if seen:
                out = [(t, bool(s), int(hits[s, i]), int(pairs[s])) for s in (0, 1) for i, t in enumerate(thresholds)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["threshold", "same", "hits", "pairs"])

        return f

    every = corpus.select("doc_id", "embedding", "label")
    blocks = [every.mapInArrow(part(ids[i : i + BLOCK], labels[i : i + BLOCK], vectors[i : i + BLOCK]), "threshold double, same boolean, hits long, pairs long") for i in range(0, max(1, len(ids)), BLOCK)]
    return reduce(DataFrame.unionByName, blocks).groupBy("threshold", "same").agg(F.sum("hits").alias("hits"), F.sum("pairs").alias("pairs"))


def within(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id): the queries for which some row of the corpus is at a cosine distance of at most `reach`.

    corpus: embedding; queries: query_id, embedding, reach. A query whose own vector is zero is at distance 1 of all rows.
    """
    asked, ids, x = _asked(queries.select("query_id", "embedding", "reach"), "euclidean")
    reach = asked.column("reach").to_numpy()
    norm = np.sqrt((x * x).sum(1)) if len(ids) else np.zeros(0)
    x = x / np.where(norm > 0, norm, 1.0)[:, None] if len(ids) else x

    def part(of: np.ndarray, block: np.ndarray, reach: np.ndarray):
        def f(batches):
            hit = np.zeros(len(of), bool)
            for b in batches:
                for start in range(0, b.num_rows if not hit.all() else 0, 1024):
                    col = b.column("embedding").slice(start, 1024)
                    hit |= np.isinf(reach)
                    y, _ = vectors(col, block.shape[1])
                    size = np.sqrt((y * y).sum(1))
                    y = y / np.where(size > 0, size, 1.0)[:, None]
                    left = np.flatnonzero(~hit)
                    for tile in tiles(len(left), 1024):
                        some = left[tile]
                        d = np.round(np.maximum(0.0, 1.0 - np.clip(block[some] @ y.T, -1.0, 1.0)), 12)
                        hit[some] |= (d <= reach[some, None]).any(1)
            yield pa.RecordBatch.from_arrays([pa.array(of[hit])], ["query_id"])

        return f

    every = corpus.select("embedding")
    blocks = [every.mapInArrow(part(ids[i : i + BLOCK], x[i : i + BLOCK], reach[i : i + BLOCK]), queries.select("query_id").schema) for i in range(0, max(1, len(ids)), BLOCK)]
    return reduce(DataFrame.unionByName, blocks).distinct()


def over_fetch(k: int, live: int, slots: int) -> int:
    """How many candidates to fetch so that k survive where only `live` of `slots` rows aren't deleted."""
    most = min(MOST_K, max(slots, k))
    if k == 0 or most <= k or live == 0 or live >= slots:
        return min(k, most)
    return max(k, min(most, math.ceil(k / (live / slots)) + max(k // 4, 2)))


def effort(k: int, rows: int, override: int | None = None) -> int:
    """Candidates that an approximate search keeps while it looks: as asked within limits, else 200, more where the collection is small."""
    if override is not None:
        return max(max(k, 1), min(override, MOST_K))
    return max(200, min(max(4 * max(rows, k), 32), 2048)) if rows <= 1024 else 200
