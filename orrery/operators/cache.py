"""Cache policies over a log, query-result caches, and other folds of ordered events.

A fold keeps a bounded state for each key and reads the key's events in order; keys are dealt to tasks, each
sorts its own and streams through them.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import clamp, cosine_similarity
from .knn import vectors, within


def fold(rows: DataFrame, key: str, order: list[str], new, step, out: T.StructType, parts: int | None = None) -> DataFrame:
    """rows with the fields that step(state, row) returns; new() is a key's first state. row is a named tuple."""
    names = [f.name for f in out.fields]

    def f(batches):
        at, state = object(), None
        for pdf in batches:
            got = []
            for row in pdf.itertuples(index=False):
                if getattr(row, key) != at:
                    at, state = getattr(row, key), new()
                got.append(step(state, row))
            yield pdf.assign(**{n: [g[i] for g in got] for i, n in enumerate(names)})

    dealt = rows.repartition(parts, key) if parts else rows.repartition(key)
    return dealt.sortWithinPartitions(key, *order).mapInPandas(f, T.StructType(rows.schema.fields + out.fields))


HIT = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("evicted", T.LongType())])


def lru(accesses: DataFrame, capacity: int, key: str = "cache_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Each access with hit and the document that it pushed out, for one LRU cache to each key."""

    def step(state: OrderedDict, row):
        doc = row.doc_id
        if doc in state:
            state.move_to_end(doc)
            return True, None
        state[doc] = True
        return False, state.popitem(last=False)[0] if len(state) > capacity else None

    return fold(accesses, key, list(order), OrderedDict, step, HIT)


#: Share of documents, by a hash of their id, that a cache without a trained model admits beyond its first quota.
SAMPLED = 0.20


def sample_point(doc_id: Column) -> Column:
    """A point of [0, 1] for each id, of 16 bits of its MD5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 4), 16, 10).cast("double") / 65535


def learned(accesses: DataFrame, capacity: int, threshold: float, *, key: str = "cache_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """As lru, but a missed document must be admitted.

    accesses: doc_id, score (null: unknown to the model), trained (whether there is a model by then). With a model a document
    comes in if its score, 0 where it is unknown, reaches the threshold. Without one, while the cache holds less than a
    quota (a tenth of the capacity, 16 to 2,048, never above the capacity), and beyond that if its hash is in a sample.
    """
    quota = min(max(16, min(2048, capacity // 10)), capacity)

    def step(cache: OrderedDict, row):
        doc = row.doc_id
        if doc in cache:
            cache.move_to_end(doc)
            return True, None
        if row.trained:
            admitted = (0.0 if pd.isna(row.score) else row.score) >= threshold
        else:
            admitted = len(cache) < quota or row.sample_at < SAMPLED
        if not admitted:
            return False, None
        cache[doc] = True
        return False, cache.popitem(last=False)[0] if len(cache) > capacity else None

    rows = accesses.withColumn("sample_at", sample_point(F.col("doc_id")))
    return fold(rows, key, list(order), OrderedDict, step, HIT).drop("sample_at")


# Fixed values of the admission by frequency and likeness.
SURE, LEAST_SEED, WEAK_LIKENESS, LIKENESS_FLOOR, ALIKE, VERY_ALIKE = 0.60, 0.20, 0.38, 0.35, 0.80, 0.96


def semantic_score(frequency: Column, likeness: Column) -> Column:
    """Both weighed, with a bonus for high likeness, in [0, 1]."""
    above = clamp((likeness - LIKENESS_FLOOR) / (1 - LIKENESS_FLOOR), 0.0, 1.0)
    bonus = F.when(likeness >= VERY_ALIKE, 0.06).when(likeness >= ALIKE, 0.02).otherwise(0.0)
    return clamp(0.55 * frequency + 0.45 * above + bonus, 0.0, 1.0)


def semantic_admission(frequency: Column, likeness: Column, threshold: float) -> Column:
    """Whether a document is admitted; likeness is null while the cache is empty, when frequency decides alone."""
    t = min(1.0, max(0.05, threshold))
    sure = frequency >= max(SURE, min(1.0, t + 0.25))
    weak = (likeness < WEAK_LIKENESS) & (frequency <= 0.75 * t)
    return F.when(sure, True).when(likeness.isNull(), frequency > max(t, LEAST_SEED)).otherwise(~weak & (semantic_score(frequency, likeness) >= t))


# Fixed values of the adaptive bias.
DEADBAND, MISS_FLOOR, STREAK_WEIGHT, STEP_SHARE, LEAST_STEP = 0.03, 0.35, 0.5, 0.35, 0.005
LEAST_FEEDBACK, LEAST_REQUESTS, LEAST_INSERTS = 4, 32, 8


def admission_bias(intervals: DataFrame, *, target: float = 0.90, most: float = 0.18) -> DataFrame:
    """intervals with bias, which is added to the admission threshold, for each cache_id in the order of pos.

    intervals: cache_id, pos, running counts hits, misses, evictions and insertions, the cache's size and capacity, and
    the documents wrongly cached (fp), wrongly left out (fn) and in a streak of misses (streak). A full cache, evictions and
    wrongly cached documents raise the bias; an empty one and misses lower it, by limited steps.
    """
    by = Window.partitionBy("cache_id").orderBy("pos")
    grown = lambda c: F.greatest(F.col(c) - F.lag(c).over(by), F.lit(0))
    share = lambda part, whole, least: F.when(F.lag("pos").over(by).isNotNull() & (whole >= least), clamp(part / whole, 0.0, 1.0)).otherwise(0.0)
    used = F.when(F.col("capacity") > 0, clamp(F.col("size") / F.col("capacity"), 0.0, 1.0)).otherwise(0.0)
    off = used - target
    fill = F.when(F.abs(off) <= DEADBAND, 0.0).when(off > 0, clamp(off / max(1 - target, 0.05), 0.0, 1.0)).otherwise(clamp(off / max(target, 0.05), -1.0, 0.0))
    cold = F.col("fn") + STREAK_WEIGHT * F.col("streak")
    total = cold + F.col("fp")
    feedback = F.when(total < LEAST_FEEDBACK, 0.0).otherwise((F.col("fp") - cold) / total)
    pressure = share(grown("evictions"), grown("insertions"), LEAST_INSERTS)
    missed = share(grown("misses"), grown("hits") + grown("misses"), LEAST_REQUESTS)
    relief = F.when((used < target - DEADBAND) & (missed > MISS_FLOOR), 0.10 * (missed - MISS_FLOOR) / (1 - MISS_FLOOR)).otherwise(0.0)
    goal = clamp(0.60 * fill + 0.25 * feedback + 0.15 * pressure - relief, -1.0, 1.0) * most
    limit = min(max(STEP_SHARE * most, LEAST_STEP), max(most, LEAST_STEP))

    def step(state, r):
        state["b"] = max(-most, min(most, state["b"] + max(-limit, min(limit, r.wanted_bias - state["b"]))))
        return (float(state["b"]),)

    rows = intervals.withColumn("wanted_bias", goal)
    return fold(rows, "cache_id", ["pos"], lambda: {"b": 0.0}, step, T.StructType([T.StructField("bias", T.DoubleType())])).drop("wanted_bias")


class Bucket:
    """Tokens up to a capacity that refills in one unit of time; it starts full."""

    __slots__ = ("at", "capacity", "tokens")

    def __init__(self, capacity: float):
        self.capacity, self.tokens, self.at = capacity, float(capacity), None

    def take(self, t: float) -> bool:
        if self.at is None or t > self.at:
            self.tokens = self.tokens if self.at is None else min(self.capacity, self.tokens + (t - self.at) * self.capacity)
            self.at = t
        if self.tokens < 1.0:
            return False
        self.tokens -= 1.0
        return True

    def refund(self) -> None:
        self.tokens = min(self.capacity, self.tokens + 1.0)


def rate_limited(requests: DataFrame, per_tenant: float, overall: float | None = None, key: str = "limiter", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """requests: limiter, tenant, t (in the unit in which a bucket refills): whether each is allowed.

    A limiter has a bucket for each tenant and one for all. A request takes a token of its tenant's and then one of
    the common bucket; where that has none, the tenant gets its token back. Limiters are independent of one another.
    """

    def step(state, r):
        mine = state["of"].setdefault(r.tenant, Bucket(per_tenant))
        if not mine.take(r.t):
            return (False,)
        if state["all"] is not None and not state["all"].take(r.t):
            mine.refund()
            return (False,)
        return (True,)

    new = lambda: {"of": {}, "all": None if overall is None else Bucket(overall)}
    return fold(requests, key, list(order), new, step, T.StructType([T.StructField("allowed", T.BooleanType())]))


def circuit_breaker(calls: DataFrame, key: str = "service", *, failures: int = 3, window_s: float = 60.0, open_s: float = 60.0, successes: int = 2, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """calls: service, t, ok: the state after each call; a call while open is refused and changes nothing.

    Failures are counted in a window that begins with the first call, anew at each success, and at a failure that finds it
    expired, which then counts as its first. At `failures` of them the circuit opens, after `open_s` the next call tests it, one
    failure opens it again and `successes` close it.
    """

    def step(s, r):
        if s["begin"] is None:
            s["begin"] = r.t
        if s["state"] == "open":
            if r.t - s["since"] < open_s:
                return "open", True
            s.update(state="half_open", good=0)
        if s["state"] == "half_open":
            s["good"] += bool(r.ok)
            if not r.ok:
                s.update(state="open", since=r.t)
            elif s["good"] >= successes:
                s.update(state="closed", bad=0, begin=r.t)
        elif r.ok:
            s.update(bad=0, begin=r.t)
        elif r.t - s["begin"] >= window_s:
            s.update(bad=1, begin=r.t)
        else:
            s["bad"] += 1
            if s["bad"] >= failures:
                s.update(state="open", since=r.t)
        return s["state"], False

    return fold(calls, key, list(order), lambda: {"state": "closed", "bad": 0, "good": 0, "since": 0.0, "begin": None}, step, T.StructType([T.StructField("state", T.StringType()), T.StructField("refused", T.BooleanType())]))


def ab_summary(metrics: DataFrame) -> DataFrame:
    """Hits, misses, hit rate and whole mean hit latency of each strategy; evictions don't count in rates."""
    hit, miss = F.col("event_type") == "hit", F.col("event_type") == "miss"
    out = metrics.groupBy("strategy").agg(F.count_if(hit).alias("hits"), F.count_if(miss).alias("misses"), F.count("*").alias("events"), F.sum(F.when(hit, F.col("latency_ns"))).alias("_ns"))
    served = F.col("hits") + F.col("misses")
    return out.select("strategy", "hits", "misses", "events", F.when(served > 0, F.col("hits") / served).otherwise(0.0).alias("hit_rate"), F.coalesce(F.expr("_ns div nullif(hits, 0)"), F.lit(0)).cast("long").alias("mean_hit_ns"))


def query_cache_lookup(asked: DataFrame, cached: DataFrame, *, threshold: float = 0.52, scan_limit: int = 2000) -> DataFrame:
    """asked: query_id, scope, hash, k, embedding; cached: cache_id, scope, hash, k, embedding, seq.

    An equal (scope, hash) answers if its k is enough, and else nothing does; without one, the most similar of
    the scope's newest `scan_limit` entries that have enough k answers if above the threshold.
    """
    c = cached.select(*(F.col(x).alias(f"c_{x}") for x in ("cache_id", "scope", "hash", "k", "embedding", "seq")))
    # of entries with one scope and hash the one with the largest k counts
    keyed = c.groupBy("c_scope", "c_hash").agg(F.max_by(F.struct("c_cache_id", "c_k"), F.struct("c_k", "c_seq")).alias("_e")).select("c_scope", "c_hash", "_e.*")
    exact = asked.join(keyed, (F.col("scope") == F.col("c_scope")) & (F.col("hash") == F.col("c_hash")), "left")
    exact = exact.withColumn("path", F.when(F.col("c_cache_id").isNull(), "none").when(F.col("c_k") >= F.col("k"), "exact").otherwise("miss"))
    near = c.withColumn("_k", F.row_number().over(Window.partitionBy("c_scope").orderBy(F.col("c_seq").desc()))).where(F.col("_k") <= scan_limit)
    left = exact.where("path = 'none'").select(*asked.columns).join(near, (F.col("scope") == F.col("c_scope")) & (F.col("c_k") >= F.col("k")))
    best = left.withColumn("sim", F.round(cosine_similarity(F.col("embedding"), F.col("c_embedding")), 12)).where(F.col("sim") > threshold)
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), F.col("c_seq").desc()))).where("_k = 1").select(F.col("query_id").alias("_q"), F.col("c_cache_id").alias("near"), "sim")
    return exact.select("query_id", "path", "c_cache_id").join(best, F.col("query_id") == F.col("_q"), "left").select("query_id", F.when(F.col("path") == "exact", F.col("c_cache_id")).otherwise(F.col("near")).alias("cache_id"), F.when(F.col("path") != "none", F.col("path")).when(F.col("near").isNotNull(), "similar").otherwise("miss").alias("path"), "sim")


def invalidated(results: DataFrame, cached: DataFrame, inserted: DataFrame) -> DataFrame:
    """Cached queries that a new vector could change: fewer results than k, or it is as near as the worst one.

    results: cache_id, distance; cached: cache_id, k, embedding; inserted: doc_id, embedding. The inserted rows are compared where they
    are read with the cached queries, which number as few as knn's queries; only hits leave a task.
    """
    worst = results.groupBy("cache_id").agg(F.max("distance").alias("worst"), F.count("*").alias("n"))
    reach = F.when(F.coalesce("n", F.lit(0)) < F.col("k"), F.lit(float("inf"))).otherwise(F.round("worst", 12))
    return within(inserted, cached.join(worst, "cache_id", "left").select(F.col("cache_id").alias("query_id"), "embedding", reach.alias("reach"))).withColumnRenamed("query_id", "cache_id")


def invalidated_by_docs(results: DataFrame, changed: DataFrame) -> DataFrame:
    """results: cache_id, doc_id; changed: doc_id. Cached queries whose results hold a changed document."""
    return results.join(changed.select("doc_id"), "doc_id", "left_semi").select("cache_id").distinct()


def query_cache_stats(lookups: DataFrame) -> DataFrame:
    """lookups: path (exact, similar, miss), sim: hits of each kind, the hit rate and the mean similarity of similar hits, in one row."""
    n = lambda path: F.count_if(F.col("path") == path)
    mean = F.coalesce(F.avg(F.when(F.col("path") == "similar", F.col("sim"))), F.lit(0.0))
    out = lookups.agg(n("exact").alias("exact_hits"), n("similar").alias("similarity_hits"), n("miss").alias("misses"), mean.alias("avg_similarity"))
    hits = F.col("exact_hits") + F.col("similarity_hits")
    return out.withColumns({"total_hits": hits, "hit_rate": F.coalesce(F.try_divide(hits, hits + F.col("misses")), F.lit(0.0))})


def flushes(inserts: DataFrame, most: int, age_s: float, *, every_s: float | None = None, hard: int | None = None, key: str = "tier_id", order: tuple[str, ...] = ("t", "doc_id")) -> DataFrame:
    """inserts: doc_id, t (seconds): size after each insert, whether the tier was drained by it or since the one before, and whether
    that was an emergency.

    A drain is due when the tier holds `most` documents, or when its last drain (before the first: its oldest document) is
    `age_s` old. That is looked at after each insert, or with `every_s` at its multiples only; then the tier grows
    until it holds `hard` documents, when the next insert drains it first. A document inserted again counts once
    and is as young as its last insert. The state is below `most` rows, or `hard` ones.
    """

    def drain(state, t: float) -> None:
        state["held"].clear()
        state["last"] = t

    def due(state, t: float) -> bool:
        since = state["last"] if state["last"] is not None else next(iter(state["held"].values()))
        return len(state["held"]) >= most or t - since >= age_s

    def tick(state) -> float:
        """The first multiple after the last insert at which a drain is due."""
        after = (state["at"] // every_s + 1) * every_s
        if len(state["held"]) >= most:
            return after
        since = state["last"] if state["last"] is not None else next(iter(state["held"].values()))
        return max(after, -(-(since + age_s) // every_s) * every_s)

    def step(state, r):
        held, drained, emergency = state["held"], False, False
        if every_s is not None and held and (at := tick(state)) <= r.t:
            drain(state, at)
            drained = True
        if hard is not None and len(held) >= hard:
            drain(state, r.t)
            drained = emergency = True
        held.pop(r.doc_id, None)
        held[r.doc_id] = state["at"] = r.t  # times rise, so the first is the oldest
        size = len(held)
        if every_s is None and due(state, r.t):
            drain(state, r.t)
            drained = True
        return size, drained, emergency

    out = T.StructType([T.StructField("size", T.LongType()), T.StructField("drained", T.BooleanType()), T.StructField("emergency", T.BooleanType())])
    return fold(inserts, key, list(order), lambda: {"held": OrderedDict(), "last": None, "at": None}, step, out)


INSERTED = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("evicted", T.LongType())])


def query_cache_inserts(events: DataFrame, capacity: int, key: str = "cache_id", order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """events with outcome and evicted (an entry's number), for one query cache to each key.

    events: op, entry (a number for scope and hash), k, seen (the generation that an insert was computed under; null: any).
    insert: skipped if the generation has moved on; an entry that is there is replaced if k is as large (updated), else kept, and is
    the newest either way; a new one pushes out the one not used for longest. lookup: hit, which makes the entry the
    newest, too_small or miss. clear: all entries go and the generation rises.
    """

    def step(s, r):
        held = s["held"]
        if r.op == "clear":
            held.clear()
            s["generation"] += 1
            return "cleared", None
        if r.op == "lookup":
            if r.entry not in held:
                return "miss", None
            if held[r.entry] < r.k:
                return "too_small", None
            held.move_to_end(r.entry)
            return "hit", None
        if not pd.isna(r.seen) and r.seen != s["generation"]:
            return "skipped", None
        if r.entry in held:
            larger = r.k >= held[r.entry]
            held[r.entry] = max(r.k, held[r.entry])
            held.move_to_end(r.entry)
            return "updated" if larger else "kept", None
        out = held.popitem(last=False)[0] if len(held) >= capacity else None
        held[r.entry] = r.k
        return "inserted", out

    return fold(events, key, list(order), lambda: {"held": OrderedDict(), "generation": 0}, step, INSERTED)


#: Cached vectors that a likeness looks at, and the likeness that ends the look.
SCANNED, ENOUGH = 2_000, 0.80


def likeness(candidates: DataFrame, cached: DataFrame, *, scanned: int = SCANNED, enough: float = ENOUGH) -> DataFrame:
    """candidates(doc_id, embedding, ...) with likeness: the first cosine of at least `enough` to one of the newest cached vectors, from the
    oldest of them on, else the largest, 0 at least; 0 where nothing is cached.

    cached: embedding, seq. Only the newest `scanned` vectors leave their tasks, so what each task holds is bounded. Vectors of
    another length, zero vectors and those that aren't finite are passed over, and have themselves a likeness of 0.
    """
    newest = cached.select("embedding", "seq").orderBy(F.col("seq").desc()).limit(scanned).toArrow().sort_by("seq")
    wide = [v for v in newest.column("embedding").to_pylist() if v and None not in v]
    by_width = {n: np.array([v for v in wide if len(v) == n], np.float64) for n in {len(v) for v in wide}}
    by_width = {n: x[np.isfinite(x).all(1) & ((x * x).sum(1) > 0)] for n, x in by_width.items()}
    by_width = {n: x / np.sqrt((x * x).sum(1))[:, None] for n, x in by_width.items() if len(x)}

    def f(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            lengths = np.array([-1 if v is None else v for v in pc.list_value_length(b.column("embedding")).to_pylist()])
            for n, x in by_width.items():
                at = np.flatnonzero(lengths == n)
                rows, ok = vectors(b.column("embedding").take(pa.array(at)), n)
                norm = np.sqrt((rows * rows).sum(1))
                at = at[ok]
                for i in range(0, len(at), 1024):
                    cos = np.round(np.clip(rows[i : i + 1024] @ x.T / np.where(norm[i : i + 1024] > 0, norm[i : i + 1024], np.inf)[:, None], -1.0, 1.0), 12)
                    hit = cos >= enough
                    out[at[i : i + 1024]] = np.where(hit.any(1), cos[np.arange(len(cos)), hit.argmax(1)], np.maximum(cos.max(1), 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], schema.names)

    rows = candidates.drop("likeness")
    schema = T.StructType([*rows.schema.fields, T.StructField("likeness", T.DoubleType())])
    return rows.mapInArrow(f, schema)


def existing(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Cached results (cache_id, doc_id, ...) whose document is still there."""
    return results.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(results.columns)
