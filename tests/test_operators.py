import io
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.operators import cache, filters, hotness, ops, ranking, store
from orrery.operators.filters import And, Exact, In, Not, Or, Range
from orrery.operators.knn import effort, ivf, knn, knn_post_filter, over_fetch, threshold_counts, within
from orrery.sources import backup, workload
from orrery.sources import io as files
from orrery.streaming import jobs

CASES = [
    (Exact("tool", "kubectl"), {"tool": "kubectl"}, True),
    (Exact("tool", "docker"), {"tool": "kubectl"}, False),
    (Range("age", "ge", "18"), {"age": "25"}, True),
    (Range("age", "lt", "20"), {"age": "25"}, False),
    (Range("date", "gt", "2022-12-31"), {"date": "2023-01-01"}, True),
    (In("status", ("pending", "active")), {"status": "active"}, True),
    (In("status", ()), {"status": "active"}, False),
    (And(), {}, True),
    (Or(), {}, False),
    (Not(Exact("none", "x")), {}, True),
    (Not(filters.Always()), {}, False),
    (Range("x", "lt", "9"), {"x": "10 "}, True),  # not a number: by bytes
    (Range("x", "ge", "1"), {"x": "nan"}, False),
    (Range("x", "ge", "1"), {"x": "+nan"}, False),
    (Range("x"), {"x": "y"}, True),
    (Range("x", "gt", "9"), {"x": "1d"}, False),
]


def test_filters(spark):
    rows = spark.createDataFrame([(i, m) for i, (_, m, _) in enumerate(CASES)], "doc_id long, metadata map<string,string>")
    for i, (f, _, want) in enumerate(CASES):
        one = rows.where(F.col("doc_id") == i)
        assert one.select(filters.compiled(f, F.col("metadata")).alias("x")).first().x is want, f
        assert (filters.matching_ids(f, one).count() == 1) is want, f


def test_vectors(spark):
    r = spark.sql("SELECT array(3f, 4f) a, array(0f, 0f) z, array(1f, 0f) u").select(V.l2_distance(F.col("a"), F.col("z")).alias("d"), V.cosine_similarity(F.col("a"), F.col("z")).alias("c0"), V.cosine_similarity(F.col("a"), F.col("a")).alias("c1"), V.distance(F.col("u"), F.col("u"), "inner_product").alias("i"), V.normalised(F.col("a")).alias("n")).first()
    assert (r.d, r.c0, r.c1, r.i) == (5.0, 0.0, 1.0, 0.0)
    assert r.n == pytest.approx([0.6, 0.8])


def test_knn_ties_and_limits(spark):
    c = spark.createDataFrame([(i, [1.0, 0.0]) for i in (5, 3, 9)] + [(1, [0.0, 1.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.doc_id for r in knn(c, q, 2).orderBy("rank").collect()] == [3, 5]
    with pytest.raises(ValueError):
        knn(c, q, 0)


def test_ranking(spark):
    r = spark.createDataFrame([("q", i, i, x) for i, x in enumerate((3.0, 2.0, 1.0))], "query_id string, doc_id long, position int, relevance double")
    d = ranking.dcg(r, 3).first()
    assert 4.7 < d.dcg < 4.8 and d.dcg == pytest.approx(d.idcg) and ranking.mrr(r).first().mrr == 1.0


def test_lru_and_breaker(spark):
    a = spark.createDataFrame([(0, i, d) for i, d in enumerate([1, 2, 1, 3, 2, 1])], "cache_id long, pos long, doc_id long")
    assert [r.hit for r in cache.lru(a, 2).orderBy("pos").collect()] == [False, False, True, False, False, False]
    c = spark.createDataFrame([("s", float(t), ok) for t, ok in [(0, False), (1, False), (2, False), (3, True), (70, True), (71, True)]], "service string, t double, ok boolean")
    assert [r.state for r in cache.circuit_breaker(c).orderBy("t").collect()] == ["closed", "closed", "open", "open", "half_open", "closed"]


def test_saturating(spark):
    e = spark.createDataFrame([("t", i, d) for i, d in enumerate([1, -3, 2, -1, -5, 4])], "tenant string, seq long, delta long")
    assert [r.value for r in ops.saturating(e, "tenant", "seq", "delta").orderBy("seq").collect()] == [1, 0, 2, 1, 0, 4]


def test_replay(spark):
    snap = spark.createDataFrame([(1, "a", "m"), (2, "b", "m")], "doc_id long, payload string, metadata string")
    log = spark.createDataFrame([(0, 5, 0, "delete", 1, None, None), (1, 11, 0, "delete", 2, None, None), (2, 12, 0, "insert", 3, "c", "x"), (3, 13, 0, "update", 3, None, "y"), (4, 14, 0, "update", 4, None, "z")], "ord long, seq long, ts long, op string, doc_id long, payload string, metadata string")
    assert {(r.doc_id, r.payload, r.metadata) for r in store.replayed(snap, log, 10, 0).collect()} == {(1, "a", "m"), (3, "c", "y")}


def test_percentile_rules(spark):
    v = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double")
    assert hotness.nearest_rank(v, ["k"], "v", [50, 99]).first()[1:] == (5.0, 9.0)
    rng = np.random.default_rng(5)
    groups = {"one": [7.0], "equal": [3.0] * 500, None: list(rng.normal(size=300)), "mixed": [1.0] * 900 + list(rng.normal(size=4000))}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)], "k string, v double")
    for rule, at in (("floor", lambda p, n: min(int(p / 100 * n), n - 1)), ("round", lambda p, n: int(p / 100 * (n - 1) + 0.5))):
        got = {r.k: tuple(r)[1:] for r in hotness.nearest_rank(rows, ["k"], "v", [0, 50, 99, 100], rule).collect()}
        assert got == {k: tuple(sorted(xs)[at(p, len(xs))] for p in (0, 50, 99, 100)) for k, xs in groups.items()}


def test_files(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    buf = io.BytesIO()
    np.save(buf, x)
    (tmp_path / "a.npy").write_bytes(buf.getvalue())
    got = files.read_npy(spark, str(tmp_path / "a.npy")).orderBy("row").collect()
    assert [r.embedding for r in got] == x.tolist()
    docs = spark.range(5).withColumnRenamed("id", "doc_id")
    files.save_snapshot(docs, str(tmp_path / "s"), 1)
    files.save_snapshot(docs.where("doc_id < 3"), str(tmp_path / "s"), 2)
    df, seq = files.load_snapshot(spark, str(tmp_path / "s"))
    assert (df.count(), seq) == (3, 2)


def test_semantic_admission(spark):
    rows = [(0.80, 0.0, True), (0.30, None, False), (0.55, None, True), (0.37, 0.37, False), (0.40, 1.0, True), (0.40, 0.40, False)]
    df = spark.createDataFrame(rows, "f double, l double, want boolean")
    assert df.where(cache.semantic_admission(F.col("f"), F.col("l"), 0.5) != F.col("want")).count() == 0
    score = df.where("l = 1").select(cache.semantic_score(F.col("f"), F.col("l")).alias("s")).first().s
    assert score == pytest.approx(0.55 * 0.4 + 0.45 + 0.06)


def test_admission_bias(spark):
    names = "cache_id long, pos long, hits long, misses long, evictions long, insertions long, size long, capacity long, fp long, fn long, streak long"
    full = [(0, 0, 0, 0, 0, 0, 100, 100, 4, 0, 0), (0, 1, 40, 0, 10, 10, 100, 100, 4, 0, 0), (0, 2, 80, 0, 20, 20, 100, 100, 4, 0, 0), (0, 3, 80, 0, 20, 20, 90, 100, 0, 0, 0)]
    empty = [(1, 0, 0, 0, 0, 0, 0, 100, 0, 4, 0), (1, 1, 0, 40, 0, 0, 0, 100, 0, 4, 0)]
    got = cache.admission_bias(spark.createDataFrame(full + empty, names)).orderBy("cache_id", "pos").collect()
    # steps of 0.063; the full cache's goals are 0.153, 0.18, 0.18 and 0
    assert [r.bias for r in got] == pytest.approx([0.063, 0.126, 0.18, 0.117, -0.063, -0.126])


def test_predictor_stats(spark):
    s = spark.createDataFrame([(i, x) for i, x in enumerate([0.1, 0.1, 0.1, 0.5, 0.9])], "doc_id long, score double")
    r = hotness.predictor_stats(s, 0.4).first()
    assert (r.tracked, r.hot, r.p50, r.p90, r.p99) == (5, 2, 0.1, 0.9, 0.9)
    none = hotness.predictor_stats(s.where("false"), 0.4).first()
    assert (none.tracked, none.hot, none["mean"], none.p50) == (0, 0, 0.0, None)


def test_flushes(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(9)), k, float(t)) for k in (0, 1) for t in np.cumsum(rng.integers(1, 40, 200))]
    want, held, last = [], {}, {}
    for d, k, t in rows:
        h = held.setdefault(k, {})
        h[d] = t
        due = len(h) >= 6 or t - last.get(k, min(h.values())) >= 90
        want.append((k, t, len(h), due))
        if due:
            held[k], last[k] = {}, t
    got = cache.flushes(spark.createDataFrame(rows, "doc_id long, tier_id long, t double"), 6, 90.0).collect()
    assert sorted((r.tier_id, r.t, r.size, r.drained) for r in got) == sorted(want)
    assert any(w[3] and w[2] < 6 for w in want) and any(w[3] and w[2] == 6 for w in want)


def test_widths():
    assert [over_fetch(10, 100, 100), over_fetch(10, 50, 100), over_fetch(10, 0, 100), over_fetch(0, 5, 9), over_fetch(10, 20, 1000)] == [10, 22, 10, 0, 502]
    assert [effort(10, 2000), effort(10, 500), effort(10, 3), effort(50, 5000, 20), effort(10, 5000, 99_999)] == [200, 2000, 200, 50, 10_000]


def test_keys_errors_and_health(spark):
    secret = "a" * 32
    cases = {f"key_t_{secret}": ("t", None), f"key_a_b_{secret}": ("a_b", None), f"key__{secret}xx": (None, "format"), f"key_t-_{secret}": (None, "tenant"), f"other_{secret}": (None, "prefix"), "key_t_short": (None, "too short"), f"key_tttttttttt_{secret[:-1]}": (None, "secret too short"), f"key_t_{secret}!": (None, "secret"), "none": (None, "prefix")}
    t, r, p = ops.api_key(F.col("k"), "key_")
    for row in spark.createDataFrame([(k,) for k in cases], "k string").select("k", t.alias("t"), r.alias("r"), p.alias("p")).collect():
        assert (row.t, row.p) == cases[row.k] and row.r == (row.k.rpartition("_")[0] + "_<redacted>" if "_" in row.k else "<redacted>")
    h = spark.createDataFrame([(0, False, 0), (1, False, 3), (0, False, 1), (2, False, 1), (0, True, 0)], "b int, i boolean, f int").select(ops.health(F.col("b"), F.col("i"), F.col("f")).alias("h"))
    assert [x.h for x in h.collect()] == ["healthy", "degraded", "degraded", "unhealthy", "unhealthy"]


def test_empty_reports(spark):
    none = spark.createDataFrame([], "doc_id long, ts timestamp")
    assert hotness.training_cycles(none, 60, 60, 1).count() == 0
    assert ops.tier_stats(spark.createDataFrame([], "tier string")).first().overall_hit_rate == 0.0
    assert cache.query_cache_stats(spark.createDataFrame([], "path string, sim double")).first().hit_rate == 0.0
    assert ranking.predictor_quality(spark.createDataFrame([], "doc_id long, admission double, accesses long")).first().mrr == 0.0


def test_saved_usage(spark, tmp_path):
    path = f"file://{tmp_path}/usage"
    assert files.restored_usage(spark, path).count() == 0
    rows = [("a", 1, 2, 3, 4, 5)]
    files.save_usage(spark.createDataFrame(rows, files.USAGE_SCHEMA), path)
    assert [tuple(r) for r in files.restored_usage(spark, path).collect()] == rows


def test_knn_passes_over_bad_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 2.0]), (8, [])]
    c = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.doc_id for r in knn(c, q, 5).orderBy("rank").collect()] == [1, 7]
    assert [r.doc_id for r in knn(c, q, 5, "euclidean").orderBy("rank").collect()] == [1, 3, 7]
    assert ivf(c, q, 5).count() == 2 and knn(c.limit(0), q, 5).count() == 0


def peak_mb(monkeypatch, search, corpus, batch):
    """What `search` gives to mapInArrow, applied here to a batch: the MB at its peak, and its rows."""
    caught = []
    with monkeypatch.context() as m:
        whole = type(corpus).mapInArrow
        m.setattr(type(corpus), "mapInArrow", lambda self, f, *a: caught.append(f) or whole(self, f, *a))
        search()
    tracemalloc.start()
    try:
        out = pa.Table.from_batches(list(caught[0]([batch])))
        return tracemalloc.get_traced_memory()[1] / 1e6, out
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def many(spark):
    """4,096 queries, and 10,000 rows as one batch of them reaches a task."""
    x = np.random.default_rng(1).normal(size=(10_000, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    ids, v = pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64()))
    meta = pa.array([[("lang", "en" if i % 2 else "de")] for i in range(10_000)], pa.map_(pa.string(), pa.string()))
    c = pa.table({"doc_id": ids, "embedding": v, "metadata": meta, "namespace": pa.array(["en"] * 10_000), "label": pa.array(np.arange(10_000) % 3)})
    q = pa.table({"query_id": ids, "embedding": v, "label": c["label"]}).slice(0, 4_096)
    return spark.createDataFrame(c), spark.createDataFrame(q), c.combine_chunks().to_batches()[0], np.round(np.maximum(0.0, 1.0 - x[:4_096] @ x.T), 12)


def test_ivf_memory_does_not_grow_with_queries(monkeypatch, many):
    c, q, batch, d = many
    mb, got = peak_mb(monkeypatch, lambda: ivf(c, q, 10, cells=256), c, batch.select(["doc_id", "embedding"]))
    assert mb < 100  # a matrix of all distances takes 328
    near = np.sort(np.argpartition(d, 9, 1)[:, :10], 1)
    found = set(zip(got["query_id"].to_pylist(), got["doc_id"].to_pylist(), strict=True))
    assert sum((i, j) in found for i, row in enumerate(near.tolist()) for j in row) >= 0.9 * 40_960


def test_search_before_filter_memory_does_not_grow_with_queries(monkeypatch, many):
    c, q, batch, d = many
    mb, got = peak_mb(monkeypatch, lambda: knn_post_filter(c, q, 10, In("lang", ("en", "fr"))), c, batch.select(["doc_id", "embedding", "metadata", "namespace"]))
    assert mb < 100
    want = np.argsort(d, 1, kind="stable")[:, :30]  # ties by doc_id, three times k
    assert got["query_id"].to_pylist() == np.repeat(np.arange(4_096), 30).tolist() and got["doc_id"].to_pylist() == want.ravel().tolist()
    assert all(m == [("lang", "en" if i % 2 else "de")] for i, m in zip(got["doc_id"].to_pylist(), got["metadata"].to_pylist(), strict=True))


def test_counts_and_reach_of_many_queries(monkeypatch, many):
    c, q, batch, d = many
    mb, got = peak_mb(monkeypatch, lambda: threshold_counts(c, q, (0.0, 0.5)), c, batch.select(["doc_id", "embedding", "label"]))
    assert mb < 100
    label, other = np.arange(10_000) % 3, np.arange(4_096)[:, None] != np.arange(10_000)
    for same in (True, False):
        pick = other & ((label[:4_096, None] == label) == same)
        for t in (0.0, 0.5):
            of = [r for r in got.to_pylist() if (r["threshold"], r["same"]) == (t, same)]
            assert (sum(r["hits"] for r in of), sum(r["pairs"] for r in of)) == ((1.0 - d[pick] >= t).sum(), pick.sum())
    reach = np.where(np.arange(4_096) % 2, -1.0, 0.1)
    mb, got = peak_mb(monkeypatch, lambda: within(c, q.withColumn("reach", F.when(F.col("query_id") % 2 == 1, -1.0).otherwise(0.1))), c, batch.select(["embedding"]))
    assert mb < 100 and got["query_id"].to_pylist() == np.flatnonzero((d <= reach[:, None]).any(1)).tolist()


def test_invalidated(spark):
    x = [1.0, 0.0]
    results = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.0), (2, 0.1), (3, 0.5)], "cache_id long, distance double")
    cached = spark.createDataFrame([(i, 2, x) for i in (1, 2, 3, 4)], "cache_id long, k long, embedding array<double>")
    new = lambda *rows: spark.createDataFrame([(7, list(v)) for v in rows], "doc_id long, embedding array<double>")
    ids = lambda df: sorted(r.cache_id for r in df.collect())
    assert ids(cache.invalidated(results, cached, new((0.985, 0.5)))) == [1, 3, 4]  # at a distance of about 0.108
    assert ids(cache.invalidated(results, cached, new((0.0, 0.0)))) == [3, 4]
    assert ids(cache.invalidated(results, cached, new().limit(0))) == []
    assert "NestedLoop" not in cache.invalidated(results, cached, new(x))._jdf.queryExecution().toString()


def test_chain_longer_than_a_recursion_limit(spark):
    rows = [(0, None, 0, "full")] + [(i, i - 1, i, "incremental") for i in range(1, 151)] + [(900, 901, 5, "incremental"), (901, 900, 5, "incremental"), (902, 555, 6, "incremental")]
    b = spark.createDataFrame(rows, "id long, parent_id long, ts long, kind string")
    assert sorted((r.id, r.step) for r in ops.chain(b, 1000).collect()) == [(i, i) for i in range(151)]
    assert sorted(r.id for r in ops.chain(b, 7).collect()) == list(range(8))
    assert ops.chain(b.where("kind <> 'full'"), 1000).count() == 0


def test_breaker_window_starts_anew(spark):
    # a success at 0, failures at 1, 50, 70 and 90: the window from 0 has expired at 70, so it holds two failures at 90
    c = spark.createDataFrame([("s", float(t), t == 0) for t in (0, 1, 50, 70, 90)], "service string, t double, ok boolean")
    assert {r.state for r in cache.circuit_breaker(c, failures=3, window_s=60.0).collect()} == {"closed"}
    c = spark.createDataFrame([("s", float(t), False) for t in (0, 1, 2, 62, 63, 130)], "service string, t double, ok boolean")
    assert [(r.state, r.refused) for r in cache.circuit_breaker(c).orderBy("t").collect()] == [("closed", False), ("closed", False), ("open", False), ("open", False), ("open", True), ("open", False)]


def test_learned_admission_without_and_with_a_model(spark):
    point = {r.doc_id: r.p for r in spark.range(60).select(F.col("id").alias("doc_id"), cache.sample_point(F.col("id")).alias("p")).collect()}
    rows = [(0, i, i, None, False) for i in range(40)] + [(0, 40 + i, 40 + i, s, True) for i, s in enumerate((None, 0.6, 0.4, 0.5))]
    got = cache.learned(spark.createDataFrame(rows, "cache_id long, pos long, doc_id long, score double, trained boolean"), 20, 0.5).orderBy("pos").collect()
    held = []
    for r in got:  # nothing repeats, so each admitted document is in the cache next
        ok = (r.score or 0) >= 0.5 if r.trained else len(held) < 16 or point[r.doc_id] < cache.SAMPLED
        held += [r.doc_id] if ok else []
        assert r.evicted == (held.pop(0) if len(held) > 20 else None)


def test_rate_limits_give_tokens_back(spark):
    rows = [(0, "a", 0.0), (0, "b", 0.1), (0, "a", 0.2), (0, "a", 0.6), (1, "a", 0.0)]
    r = spark.createDataFrame(rows, "limiter long, tenant string, t double")
    assert [x.allowed for x in cache.rate_limited(r, 2.0, 1.0).orderBy("limiter", "t").collect()] == [True, False, False, False, True]
    assert [x.allowed for x in cache.rate_limited(r, 2.0).orderBy("limiter", "t").collect()] == [True] * 5


def test_emergency_flush(spark):
    rows = [(i, 0, 1.0 + i) for i in range(9)]
    got = cache.flushes(spark.createDataFrame(rows, "doc_id long, tier_id long, t double"), 3, 90.0, every_s=7.0, hard=4).orderBy("t").collect()
    # at the tick of 7 the tier holds two documents, so only size counts: four fill it before the tick, the next drains it
    assert [(r.size, r.drained, r.emergency) for r in got] == [(1, False, False), (2, False, False), (3, False, False), (4, False, False), (1, True, True), (2, False, False), (3, False, False), (4, False, False), (1, True, True)]


def test_likeness(spark):
    cached = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 3.0], 2), ([0.0], 3), ([0.0, 0.0], 4), ([float("nan"), 1.0], 5)], "embedding array<double>, seq long")
    c = spark.createDataFrame([(1, [1.0, 1.0], "x"), (2, [-1.0, -1.0], "y"), (3, None, "z"), (4, [0.0, 0.0], "w"), (5, [5.0], "v")], "doc_id long, embedding array<double>, likeness string")
    got = {r.doc_id: r.likeness for r in cache.likeness(c, cached).collect()}
    assert got == pytest.approx({1: 2**-0.5, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0})
    near = spark.createDataFrame([(1, [0.9, 0.5])], "doc_id long, embedding array<double>")
    assert cache.likeness(near, cached, enough=0.4).first().likeness == pytest.approx(0.9 / 1.06**0.5)  # the first of two that would do
    assert cache.likeness(near, cached, scanned=4, enough=0.4).first().likeness == pytest.approx(0.5 / 1.06**0.5)
    assert cache.likeness(near, cached.limit(0)).first().likeness == 0.0


def test_change_log_files(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = [(i, i, 0, "insert", i, None, 'a "b"\nc') for i in range(5)]
    files.write_log(spark.createDataFrame(rows, files.LOG_SCHEMA), path)
    assert sorted(tuple(r) for r in files.read_log(spark, path, strict=True).collect()) == rows
    (tmp_path / "log" / "part-damaged.txt").write_text('0badbad0 {"ord":9}\n\nhalf')
    assert files.read_log(spark, path).count() == 5
    with pytest.raises(Exception, match="damaged"):
        files.read_log(spark, path, strict=True).collect()


def test_backups_listed(spark, tmp_path):
    for name, text in (("a.json", '{"id": "a", "timestamp": 3, "kind": "full"}'), ("b.json", '{"id": "b", "timestamp": 7}'), ("c.json", "{broken"), ("d.txt", '{"id": "d", "timestamp": 9}')):
        (tmp_path / name).write_text(text)
    assert [r.id for r in files.list_backups(spark, f"file://{tmp_path}").collect()] == ["b", "a"]


def test_damaged_snapshots_give_way(spark, tmp_path):
    root, docs = f"{tmp_path}/s", spark.range(5).withColumnRenamed("id", "doc_id")
    for seq in (1, 2, 3):
        files.save_snapshot(docs.where(F.col("doc_id") < seq), root, seq)
    for p in (tmp_path / "s" / f"snapshot-{3:020d}").glob("part*"):
        p.write_bytes(b"not parquet")
    bad = spark.read.parquet(f"{root}/snapshot-{2:020d}").withColumn("_crc", F.col("_crc") + 1).toPandas()
    spark.createDataFrame(bad).write.mode("overwrite").parquet(f"{root}/snapshot-{2:020d}")
    assert files.load_snapshot(spark, root)[1] == 1
    assert files.load_snapshot(spark, root, strict=False)[0].count() == 0  # the second, without its bad rows


def test_ab_and_usage_files(spark, tmp_path):
    rows = [(1, "lru", "hit", 4, 100), (2, "learned", "miss", None, 0)]
    files.write_ab(spark.createDataFrame(rows, files.AB_SCHEMA), f"{tmp_path}/ab")
    assert sorted(tuple(r) for r in files.read_ab(spark, f"{tmp_path}/ab").collect()) == rows
    files.write_usage(spark.createDataFrame([("t", 3 << 19)], "tenant string, storage_bytes long"), f"{tmp_path}/usage")
    assert spark.read.csv(f"{tmp_path}/usage", header=True).first().storage_mb == "1.50"


def test_small_functions(spark):
    f = filters.from_legacy({"b": "2", "a": "1"}, Exact("c", "3"))
    assert f == And((Exact("a", "1"), Exact("b", "2"), Exact("c", "3"))) and filters.from_legacy({}) == filters.Always() and filters.from_legacy({}, f) is f
    one = spark.sql("SELECT array(0.1D, 0.2D) a, array(0.1000001D, 0.2D) b, array(0.2D, 0.1D) c, map('x', '1', '__namespace__', 'n') m")
    h = V.quantised_hash
    r = one.select((h(F.col("a")) == h(F.col("b"))).alias("same"), (h(F.col("a")) == h(F.col("c"))).alias("other"), V.public_metadata(F.col("m")).alias("public"), V.with_reserved(F.col("m"), F.lit("t"), F.lit(3), F.lit("z")).alias("all")).first()
    assert (r.same, r.other, r.public) == (True, False, {"x": "1"}) and r.all == {"x": "1", "__tenant_id__": "t", "__tenant_idx__": "3", "__namespace__": "z"}
    sizes = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1536, 5 << 20, 3 << 30)], "n long").select(V.format_bytes(F.col("n")).alias("t")).collect()
    assert [x.t for x in sizes] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 MB", "3.00 GB"]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(d, f"2024-01-01 00:00:{s:02d}") for d, s in ((1, 0), (1, 10), (2, 5), (1, 30))], "doc_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(2):
        log.where(F.second("ts") < 20 if part == 0 else F.second("ts") >= 20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    q = jobs.running_hotness(stream, 10.0).writeStream.format("memory").queryName("hot").outputMode("update").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.doc_id: r.hotness for r in spark.sql("SELECT doc_id, max_by(hotness, asof_s) AS hotness FROM hot GROUP BY doc_id").collect()}
    assert last == pytest.approx({1: np.exp(-3) + np.exp(-2) + 1, 2: 1.0})
    spans = jobs.sessions(log, "15 seconds").orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.accesses) for r in spans] == [(1, 2), (1, 1), (2, 1)]
    corpus = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.0, 1.0])], "doc_id long, embedding array<double>")
    spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.1, 1.0])], "query_id long, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/q")
    found = []
    asked = spark.readStream.schema("query_id long, embedding array<double>").parquet(f"{tmp_path}/q")
    q = jobs.bulk_search(asked, corpus, 1, lambda df, batch: found.extend((r.query_id, r.doc_id) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(found) == [(1, 5), (2, 6)]


def test_windows_by_slide_and_by_window_agree(spark):
    log = spark.createDataFrame([(d % 3, f"2024-01-01 0{d % 7}:1{d % 6}:00") for d in range(40)], "doc_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = lambda width, slide: sorted(map(tuple, jobs.windowed_counts(log, width, slide).collect()))
    want = log.groupBy(F.window("ts", "1 hour", "10 minutes").alias("w"), "doc_id").count().select("w.start", "w.end", "doc_id", "count").collect()
    assert rows("1 hour", "10 minutes") == sorted(map(tuple, want)) and len(rows("1 hour", "25 minutes")) > 0


def test_backups(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    changes = lambda rows: spark.createDataFrame(rows, "doc_id long, seq long, op string, payload string")
    first = [(1, 1, "insert", "a"), (2, 2, "insert", "b")]
    later = [(1, 3, "update", "c"), (2, 4, "delete", None), (3, 5, "insert", "d")]
    backup.save(changes(first), folder, "one", at=10)
    backup.save(changes(first + later), folder, "two", parent="one", at=20)
    backup.save(changes(first + later), folder, "three", parent="two", at=30)
    rows = lambda **k: sorted((r.doc_id, r.seq, r.payload) for r in backup.restore(spark, folder, **k).collect())
    assert rows() == [(1, 3, "c"), (3, 5, "d")] and rows(until=19) == [(1, 1, "a"), (2, 2, "b")]
    assert [r.id for r in files.list_backups(spark, folder).collect()] == ["three", "two", "one"]
    assert backup.verify(spark, folder, "two") and backup.metadata(spark, folder, "two")["rows"] == 3
    bad = spark.read.parquet(f"{folder}/two.data").withColumn("payload", F.lit("x")).toPandas()
    spark.createDataFrame(bad, "doc_id long, seq long, op string, payload string, _crc long").write.mode("overwrite").parquet(f"{folder}/two.data")
    assert not backup.verify(spark, folder, "two")
    with pytest.raises(Exception, match="damaged"):
        rows()
    with pytest.raises(FileNotFoundError):
        rows(until=1)


def test_workloads(spark):
    log = workload.accesses(spark, 20_000, 100, exponent=1.1, seed=3)
    n = {r.doc_id: r["count"] for r in log.groupBy("doc_id").count().collect()}
    assert sum(n.values()) == 20_000 and set(n) <= set(range(100)) and n[0] > n[5] > n[40]
    assert log.exceptAll(workload.accesses(spark, 20_000, 100, exponent=1.1, seed=3).repartition(3)).count() == 0
    assert workload.accesses(spark, 1000, 10, exponent=1.0).where("doc_id < 0 OR doc_id > 9").count() == 0
    other = workload.accesses(spark, 4_000, 100, cold=0.5, spike=(1_000, 2_000, 77), every=2_000).groupBy((F.col("pos") / 1000).cast("int").alias("k"), "doc_id").count()
    top = {k: max((r for r in other.collect() if r.k == k), key=lambda r: r["count"]).doc_id for k in range(4)}
    assert (top[0], top[1], top[2]) == (0, 77, 12)
    pools = spark.createDataFrame([(d, p, 10 * d + p) for d in range(5) for p in range(3)], "doc_id long, place long, query_id long")
    asked = workload.paraphrases(log, pools, sticky=0.6).collect()
    assert len(asked) == 20_000 and all((r.query_id is None) == (r.doc_id >= 5) and (r.query_id is None or r.query_id // 10 == r.doc_id) for r in asked)
    first = [r.query_id % 10 == 0 for r in asked if r.doc_id < 5]
    assert 0.68 < sum(first) / len(first) < 0.79
