"""Exact top-k by inner product: best-first search of M-trees.

A vector x becomes whole numbers and one more coordinate that gives all vectors of a tree the norm M, so that
|q - x|^2 = |q|^2 + M^2 - 2 qx: the nearest has the largest inner product. A tree's nodes have a routing vector,
a covering radius and the distance to their parent's router; they and the vectors are written by tasks to
shared files, one tree for each hash shard of the rows, and mapped by the workers. A query searches all trees
with one queue, best bound first. |d(q, parent) - d(x, parent)| bounds d(q, x) from below: rows and nodes that it
rules out are left before any product is taken. Scores are whole numbers and exact; a node that can only tie is left out if all its ids are larger
than the worst kept one, so many equal vectors cost one page.

Nulls and edges: vectors that are null, or hold a null, infinite or NaN component, and rows without an id take
no part; shorter vectors count as padded with zeros; an empty vector scores 0; a row with the query's own id is no
candidate; repeated rows are answers and queries of their own; an empty table gives an empty one; ids are whole numbers (a text that is none
raises); other columns are left out. Sums beyond 2^63 are not supported.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store as S

ROWS_PER_TREE = 32_768
#: Rows of a page, and children of a node, at most.
PAGE, FAN = 128, 16


def _matrix(col, width: int, scale: float) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, np.int32)
    flat = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _dots(x: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers; bound is the product of the squared norms, above each partial sum's square."""
    if bound >= 2.0**104:
        return x.astype(np.int64) @ q.astype(np.int64)
    return x @ q


def tree(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes in the order in which they were made, the root first; a page's rows are neighbours, by rising distance to its router.

    A node's rows go to the nearest of at most FAN routers: rows drawn by their squared distance to those before, then twice the row
    nearest to the mean of its group, which makes the covering radii small.
    """
    top = float((x * x).sum(1).max(initial=0))
    lift = np.sqrt(np.maximum(top - (x * x).sum(1), 0))
    slack = 1e-6 * np.sqrt(2 * top + 1)

    def far(rows: np.ndarray, routers: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * top - 2 * (x[rows] @ x[routers].T + lift[rows, None] * lift[routers]), 0))

    def centre(rows: np.ndarray) -> int:
        return int(rows[(x[rows] @ x[rows].mean(0) + lift[rows] * lift[rows].mean()).argmax()])

    rng = np.random.default_rng(len(ids))
    every = np.argsort(ids, kind="stable")
    router, radius, up, links, least = [centre(every)], [0.0], [0.0], [[0, 0, 0]], [int(ids.min())]
    order: list[np.ndarray] = []
    apart: list[np.ndarray] = []
    placed, queue, done = 0, [every], 0
    while done < len(queue):
        k, rows = done, queue[done]
        done += 1
        d = far(rows, np.array([router[k]]))[:, 0]
        radius[k] = float(d.max()) + slack
        if len(rows) <= PAGE:
            by = np.argsort(d, kind="stable")
            links[k] = [placed, placed + len(rows), 1]
            order.append(rows[by])
            apart.append(d[by])
            placed += len(rows)
            continue
        some = rows if len(rows) <= 512 else rng.choice(rows, 512, replace=False)
        picked, gap = [int(some[0])], far(some, some[:1])[:, 0]
        while len(picked) < min(FAN, -(-5 * len(rows) // (4 * PAGE))) and gap.max() > slack:
            picked.append(int(rng.choice(some, p=gap**2 / (gap**2).sum())))
            gap = np.minimum(gap, far(some, np.array(picked[-1:]))[:, 0])
        routers = np.array(picked)
        for _ in range(2):
            near = far(rows, routers).argmin(1)
            routers = np.array([centre(rows[near == i]) for i in range(len(routers)) if (near == i).any()])
        near = far(rows, routers).argmin(1)
        groups = [(int(r), rows[near == i]) for i, r in enumerate(routers) if (near == i).any()]
        if len(groups) == 1:  # nothing tells the rows apart: cut them by id
            groups = [(int(g[0]), g) for g in np.array_split(rows, min(FAN, -(-len(rows) // PAGE)))]
        links[k] = [len(router), len(router) + len(groups), 0]
        for r, g in groups:
            queue.append(g)
            router.append(r)
            radius.append(0.0)
            up.append(float(far(np.array([r]), np.array([router[k]]))[0, 0]))
            links.append([0, 0, 0])
            least.append(int(ids[g].min()))
    rows = np.concatenate(order)
    return {"key": ids[rows], "x": x[rows], "apart": np.concatenate(apart), "router": x[router], "radius": np.array(radius), "up": np.array(up), "links": np.array(links, np.int64), "least": np.array(least, np.int64), "top": np.array([top])}


class Search:
    """Best-first search over all trees. computed counts the rows and routers whose product with a query was taken."""

    def __init__(self, store: S.Store):
        names = ("key", "x", "apart", "router", "radius", "up", "links", "least", "top")
        self.trees = [{n: np.asarray(store.array(s, n)) for n in names} for s in sorted(store.sizes)]
        self.tops = np.array([t["top"][0] for t in self.trees])
        self.roots = np.stack([t["router"][0] for t in self.trees])
        self.reach = np.array([t["radius"][0] for t in self.trees])
        self.computed = 0

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than `own`, best first."""
        q2 = float(q @ q)
        scores, ids = np.zeros(0), np.zeros(0, np.int64)
        # a row's distance to q follows from its inner product with q, as all vectors of a tree have one norm
        dist = lambda top, y: np.sqrt(np.maximum(q2 + top - 2 * (y @ q), 0))
        bound = lambda top, d: np.floor((q2 + top - np.maximum(d, 0) ** 2) / 2 + 1e-6 * (q2 + top + 1))
        slack = (1e-6 * np.sqrt(q2 + self.tops + 1)).tolist()
        d = dist(self.tops, self.roots)
        self.computed += len(d)
        heap = [(-b, int(t["least"][0]), i, 0, x) for i, (t, b, x) in enumerate(zip(self.trees, bound(self.tops, d - self.reach - np.array(slack)).tolist(), d.tolist(), strict=True))]
        heapq.heapify(heap)
        worst = -math.inf  # the score to reach
        while heap:
            b, least, i, node, d = heapq.heappop(heap)
            if -b < worst:
                break
            if -b == worst and least > ids[-1]:
                continue
            t, top = self.trees[i], float(self.tops[i])
            lo, hi, leaf = t["links"][node].tolist()
            # |d(q, router) - d(x, router)| bounds d(q, x) from below: what lies outside the ring needs no product
            ring = math.inf if worst == -math.inf else math.sqrt(max(q2 + top - 2 * worst, 0)) + 2 * slack[i]
            if leaf:
                if ring < math.inf:
                    near, far = t["apart"][lo:hi].searchsorted((d - ring, d + ring)).tolist()
                    lo, hi = lo + near, lo + far
                    if lo == hi:
                        continue
                self.computed += hi - lo
                s = _dots(t["x"][lo:hi], q, q2 * top)
                at = (s >= worst).nonzero()[0]
                at = at[t["key"][lo:hi][at] != own] if len(at) else at
                if len(at):
                    scores, ids = np.concatenate([scores, s[at]]), np.concatenate([ids, t["key"][lo:hi][at]])
                    first = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[first], ids[first]
                    worst = float(scores[-1]) if len(ids) == k else worst
                continue
            kids = np.arange(lo, hi)
            if ring < math.inf:
                kids = kids[np.abs(d - t["up"][lo:hi]) - t["radius"][lo:hi] <= ring]
            if len(kids):
                self.computed += len(kids)
                ds = dist(top, t["router"][kids])
                bounds = bound(top, ds - t["radius"][kids] - slack[i])
                for b, c, x, n in zip(bounds.tolist(), kids.tolist(), ds.tolist(), t["least"][kids].tolist(), strict=True):
                    if b >= worst:
                        heapq.heappush(heap, (-b, n, i, c, x))
        return ids, scores


def whole(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(rows: DataFrame, queries: Column, *, k: int = 20, scale: float = 64.0) -> DataFrame:
    """rows(vec_id, embedding): of each row for which `queries` holds, the k others with the largest inner product of floor(scale * x)."""
    spark = rows.sparkSession
    home = S.workspace(spark, "topk")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull()).where(whole("embedding"))
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    width = max(1, about.d or 1)
    shards = max(1, -(-about.n // ROWS_PER_TREE))
    store, _ = S.build(rows.select(F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id() % 8), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding"), shards, lambda s, t: tree(t.column("vec_id").to_numpy(), _matrix(t.column("embedding"), width, scale)), f"{home}/trees")

    def f(batches):
        search = None
        for b in batches:
            search = search or Search(store)
            q = _matrix(b.column("embedding"), width, scale)
            out: tuple[list, ...] = ([], [], [], [])
            for own, x in zip(b.column("vec_id").to_pylist(), q, strict=True):
                ids, scores = search.best(own, x, k)
                for col, v in zip(out, ([own] * len(ids), range(1, len(ids) + 1), ids.tolist(), [int(s) for s in scores]), strict=True):
                    col.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["query_id", "rank", "vec_id", "score"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), about.n // 20_000)
    return rows.where(queries).repartition(parts).mapInArrow(f, "query_id long, rank int, vec_id long, score long")
