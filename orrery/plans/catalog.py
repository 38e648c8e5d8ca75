"""All registered queries of the reference's operators, each with the same in SQL where SQL can express it.

The corpus is all embeddings, with the documents of the same ids; language, source and length are its metadata, the language its
namespace, the label modulo 3 its tenant. Searches ask for every row whose id is divisible by 100. The access log is
the events table, a user being the document; times are read as of the log's last event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import cache, hotness, knn, merge, ops, ranking, store
from ..operators.filters import Always, And, Exact, In, Not, Or, Range, compiled, from_legacy, matching_ids, of_tenant, scope
from ..streaming import jobs

K, DAY = 10, 86400.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus for searches that ask for no metadata."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return e.withColumn("tenant", F.col("label") % 3)


def corpus(spark: SparkSession, sf: str, how: str = "left") -> DataFrame:
    """With metadata, null where there is no document; inner leaves such rows out."""
    d = docs(spark, sf).withColumn("namespace", F.col("metadata")["lang"])
    return vectors(spark, sf).join(d, "doc_id", how)


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").select("doc_id", meta.alias("metadata"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


CORPUS = """q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings WHERE vec_id % 100 = 0),
c AS (SELECT e.vec_id AS doc_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS b, d.lang, d.source, d.n_chars, e.label FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id)"""
DOT = "list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))"
L2 = "sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
COS = f"greatest(0.0, 1 - {DOT})"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _knn_sql(distance: str, score: str, where: str = "true", least: float | None = None) -> str:
    return f"""WITH {CORPUS}, d AS (SELECT query_id, doc_id, round({distance}, 12) AS distance FROM q CROSS JOIN c WHERE {where}),
s AS (SELECT *, {score} AS score FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank FROM s{f' WHERE score >= {least}' if least else ''})
SELECT query_id, rank, doc_id, round(distance, 6) AS distance, round(score, 6) AS score FROM r WHERE rank <= {K}"""


def _found(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "doc_id", r6("distance").alias("distance"), r6("score").alias("score"))


@query(_knn_sql(COS, "1 - distance"))
def knn_cosine(spark, sf):
    return _found(knn.knn(vectors(spark, sf), asked(spark, sf), K))


@query(_knn_sql(L2, "1 / (1 + distance)"))
def knn_euclidean(spark, sf):
    return _found(knn.knn(vectors(spark, sf), asked(spark, sf), K, "euclidean"))


@query(_knn_sql(COS, "1 - distance"))
def knn_inner_product(spark, sf):
    return _found(knn.knn(vectors(spark, sf), asked(spark, sf), K, "inner_product"))


@query(_knn_sql(COS, "1 - distance", least=0.25))
def knn_min_score(spark, sf):
    return _found(knn.knn(vectors(spark, sf), asked(spark, sf), K, min_score=0.25))


FILTER = And((In("lang", ("en", "fr")), Range("n_chars", "ge", "1000")))


@query(_knn_sql(COS, "1 - distance", "lang IN ('en', 'fr') AND n_chars >= 1000"))
def knn_filtered_pre(spark, sf):
    return _found(knn.knn(corpus(spark, sf), asked(spark, sf), K, where=FILTER))


def _post_sql(wide: int, extra: str = "true") -> str:
    return f"""WITH {CORPUS}, d AS (SELECT query_id, doc_id, lang, n_chars, round({COS}, 12) AS distance FROM q CROSS JOIN c),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS k FROM d),
f AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_found, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank FROM w WHERE k <= {wide} AND lang IN ('en', 'fr') AND n_chars >= 1000 AND {extra})
SELECT query_id, rank, doc_id, round(distance, 6) AS distance, round(1 - distance, 6) AS score, total_found FROM f WHERE rank <= {K}"""


@query(_post_sql(30))
def knn_filtered_post(spark, sf):
    return knn.knn_post_filter(corpus(spark, sf), asked(spark, sf), K, FILTER).withColumns({"distance": r6("distance"), "score": r6("score")})


@query(_post_sql(100, "lang = 'en'"))
def knn_total_found(spark, sf):
    return knn.knn_post_filter(corpus(spark, sf), asked(spark, sf), K, FILTER, namespace="en").withColumns({"distance": r6("distance"), "score": r6("score")})


@query(_knn_sql(COS, "1 - distance", "label % 3 = 1"))
def tenant_isolated_knn(spark, sf):
    return _found(knn.knn(vectors(spark, sf).where("tenant = 1"), asked(spark, sf), K))


def ivf_recalls(spark, sf):
    """Recall of the approximate search against the exact one, for each query."""
    c, q = vectors(spark, sf), asked(spark, sf)
    exact, near = knn.knn(c, q, K).select("query_id", "doc_id"), knn.ivf(c, q, K).select("query_id", F.col("doc_id").alias("found"))
    hit = exact.join(near.withColumnRenamed("query_id", "q2"), (F.col("query_id") == F.col("q2")) & (F.col("doc_id") == F.col("found")), "left")
    return hit.groupBy("query_id").agg((F.count("found") / F.count("*")).alias("recall"))


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def knn_ivf_recall(spark, sf):
    """Whether the mean recall of the approximate search is 0.9 or more; its exact value depends on the cells."""
    return ivf_recalls(spark, sf).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(b, lambda x: x * x))), 6) AS norm, round(list_sum(b), 6) AS total, len(b)::INTEGER AS n FROM v""")
def vector_norms(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", r6(V.l2_norm(e)).alias("norm"), r6(F.aggregate(V.as_double(e), F.lit(0.0), lambda s, x: s + x)).alias("total"), F.size(e).alias("n"))


def _filter_query(name: str, f, sql: str) -> None:
    def run(spark, sf):
        return docs(spark, sf).where(compiled(f, F.col("metadata"))).select("doc_id")

    run.__name__ = name
    query(f"SELECT doc_id FROM documents WHERE {sql}")(run)


_filter_query("filter_exact", Exact("lang", "de"), "lang = 'de'")
_filter_query("filter_range_num", Range("n_chars", "lt", "1000.5"), "n_chars < 1000.5")
_filter_query("filter_range_lex", Range("source", "ge", "src15"), "source >= 'src15'")
_filter_query("filter_in", In("source", ("src1", "src3", "none")), "source IN ('src1', 'src3', 'none')")
_filter_query("filter_and", And((Exact("lang", "en"), Range("n_chars", "gt", "500"))), "lang = 'en' AND n_chars > 500")
_filter_query("filter_or", Or((Exact("lang", "es"), Exact("source", "src2"))), "lang = 'es' OR source = 'src2'")
_filter_query("filter_not", Not(Or((Exact("lang", "en"), Exact("nokey", "x")))), "lang <> 'en'")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 1000 AND NOT (source = 'src2')")
def filter_index_equiv(spark, sf):
    return matching_ids(And((FILTER, Not(Exact("source", "src2")))), docs(spark, sf))


@query("""SELECT e.event_id AS pos, e.user_id * 7 AS doc_id, d.doc_id IS NOT NULL AS found, d.lang FROM events e LEFT JOIN documents d ON e.user_id * 7 = d.doc_id""")
def bulk_query_positional(spark, sf):
    ids = log(spark, sf).select(F.col("event_id").alias("pos"), (F.col("doc_id") * 7).alias("doc_id"))
    return store.lookup(docs(spark, sf), ids).select("pos", "doc_id", "found", F.col("metadata")["lang"].alias("lang"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)")
def batch_delete_ids(spark, sf):
    return store.without_ids(docs(spark, sf), log(spark, sf)).select("doc_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE NOT (lang = 'en' AND n_chars > 2000) GROUP BY lang")
def batch_delete_filter(spark, sf):
    left = store.without_matching(docs(spark, sf), And((Exact("lang", "en"), Range("n_chars", "gt", "2000"))))
    return left.groupBy(F.col("metadata")["lang"].alias("lang")).agg(F.count("*").alias("n"))


def _updates(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.create_map(F.lit("lang"), F.lit("xx"), F.lit("quality"), F.col("quality").cast("string")).alias("new"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'xx' END AS lang, d.source, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_merge(spark, sf):
    m = F.col("metadata")
    return store.updated(docs(spark, sf), _updates(spark, sf), True).select("doc_id", m["lang"].alias("lang"), m["source"].alias("source"), m["quality"].alias("quality"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source END AS source, CAST(l.quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_replace(spark, sf):
    m = F.col("metadata")
    return store.updated(docs(spark, sf), _updates(spark, sf), False).select("doc_id", m["source"].alias("source"), m["quality"].alias("quality"))


@query(f"""WITH {CORPUS}, d AS (SELECT query_id, doc_id, round({COS}, 12) AS distance, label FROM q CROSS JOIN c),
r AS (SELECT query_id, doc_id, distance, CASE WHEN label < 3 THEN 0 ELSE 1 END AS tier FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank FROM r)
SELECT query_id, doc_id, rank, tier FROM k WHERE rank <= {K}""")
def tier_merge(spark, sf):
    c, q = vectors(spark, sf), asked(spark, sf)
    hot, cold = knn.knn(c.where("label < 3"), q, 2 * K), knn.knn(c, q, 2 * K)
    return merge.merged_top_k(hot, cold, K).select("query_id", "doc_id", "rank", "tier")


def _changes(spark, sf):
    """A change log of orders: customers are documents, F deletes, P updates, O inserts."""
    o = table(spark, sf, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "delete").when(F.col("o_orderstatus") == "P", "update").otherwise("insert")
    return o.select(F.col("o_custkey").cast("long").alias("doc_id"), F.col("o_orderkey").cast("long").alias("ord"), F.col("o_orderkey").cast("long").alias("seq"), F.lit(0).cast("long").alias("ts"), op.alias("op"), F.col("o_orderkey").cast("long").alias("payload"), F.col("o_orderpriority").alias("metadata"))


_LOG = "l AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'P' THEN 'update' ELSE 'insert' END AS op, o_orderpriority AS metadata FROM orders)"


@query(f"""WITH {_LOG}, e AS (SELECT c_custkey AS doc_id, -1 AS ord, 'insert' AS op, c_mktsegment AS metadata, -1 AS payload FROM customer UNION ALL SELECT doc_id, ord, op, metadata, ord FROM l WHERE ord > 1000),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS k FROM e WHERE op <> 'update'),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS k FROM e WHERE op = 'update')
SELECT b.doc_id, b.payload, CASE WHEN u.ord > b.ord THEN u.metadata ELSE b.metadata END AS metadata FROM b LEFT JOIN u ON b.doc_id = u.doc_id AND u.k = 1 WHERE b.k = 1 AND b.op = 'insert'""")
def wal_replay(spark, sf):
    snap = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.lit(-1).cast("long").alias("payload"), F.col("c_mktsegment").alias("metadata"))
    return store.replayed(snap, _changes(spark, sf), 1000, 0)


@query(f"""WITH {_LOG}, g AS (SELECT doc_id, max(ord) FILTER (WHERE op = 'delete') AS gone FROM l GROUP BY doc_id), a AS (SELECT l.* FROM l JOIN g ON l.doc_id = g.doc_id WHERE gone IS NULL OR ord > gone)
SELECT doc_id, max(ord) AS seq, count(*) AS version FROM a GROUP BY doc_id""")
def latest_state(spark, sf):
    return store.latest(_changes(spark, sf)).select("doc_id", "seq", "version")


@query("SELECT v.vec_id AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN v.label = 9 THEN 'corrupt' WHEN v.label % 2 = 1 THEN 'stale' ELSE 'match' END AS status FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id")
def coherence_check(spark, sf):
    e = table(spark, sf, "embeddings")
    hot = e.select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("version"), V.digest(F.col("embedding")).alias("digest"), F.when(F.col("label") == 9, 0).otherwise(V.digest(F.col("embedding"))).alias("actual"))
    cold = corpus(spark, sf, "inner").select("doc_id", F.when(F.col("label") % 2 == 1, 2).otherwise(1).alias("version"), V.digest(F.col("embedding")).alias("digest"))
    return store.coherence(hot, cold)


@query("SELECT v.vec_id AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'repair' WHEN v.label = 9 THEN 'keep_cold_diverged' ELSE 'keep_cold' END AS action FROM embeddings v LEFT JOIN documents d ON v.vec_id = d.doc_id")
def drain_actions(spark, sf):
    hot = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") == 9, 0).otherwise(V.digest(F.col("embedding"))).alias("digest"))
    return merge.drain(hot, corpus(spark, sf, "inner").select("doc_id", V.digest(F.col("embedding")).alias("digest")))


@query("SELECT vec_id, (label::BIGINT << 32) | vec_id AS gid, label::BIGINT AS tenant, vec_id AS local FROM embeddings")
def tenant_id_map(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", V.global_id(F.col("label"), F.col("vec_id")).alias("gid"))
    t, local = V.split_id(F.col("gid"))
    return e.select("vec_id", "gid", t.alias("tenant"), local.alias("local"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def first_passages(spark, sf):
    return merge.first_of_equal(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id")


@query("""SELECT (SELECT count(doc_id) - count(DISTINCT doc_id) FROM documents) AS duplicates, (SELECT count(DISTINCT len(embedding)) FROM embeddings) AS dimensions,
(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS without_metadata, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS without_document""")
def snapshot_check(spark, sf):
    return store.snapshot_problems(table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), table(spark, sf, "documents"))


WINDOW, HALF = 7 * DAY, DAY
_HOT = f"""m AS (SELECT max(ts) AS t FROM events), a AS (SELECT user_id AS doc_id, ts, epoch_us(t) - epoch_us(ts) AS age FROM events, m WHERE epoch_us(ts) >= epoch_us(t) - {int(WINDOW * 1e6)}),
h AS (SELECT doc_id, sum(exp(-(age / 1e6) / {HALF})) AS raw, count(*) AS accesses, min(age) / 1e6 AS last_age FROM a GROUP BY doc_id),
s AS (SELECT *, CASE WHEN last_age <= 3600 THEN least(1.0, ln(1 + raw) / ln(1 + max(raw) OVER ()) + 0.12) ELSE ln(1 + raw) / ln(1 + max(raw) OVER ()) END AS score FROM h)"""


def _scores(spark, sf):
    """The log's last event and the largest sum are joined as one row each, so no job runs before the result's."""
    l = log(spark, sf)
    asof = hotness.one_row(l, l.agg(F.max("ts").alias("asof")))
    return hotness.normalised(hotness.hotness(asof, F.col("asof"), WINDOW, HALF), boost_s=3600)


@query(f"WITH {_HOT} SELECT doc_id, round(raw, 6) AS raw, accesses, round(score, 6) AS score FROM s")
def hot_documents(spark, sf):
    return _scores(spark, sf).select("doc_id", r6("raw").alias("raw"), "accesses", r6("score").alias("score"))


@query(f"WITH {_HOT} SELECT round(0.8 * 0.5 + 0.2 * greatest(0.05, least(1.0, min(score))), 6) AS threshold FROM (SELECT score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 50)")
def hotness_threshold(spark, sf):
    return hotness.recalibrated(_scores(spark, sf).withColumn("score", F.round("score", 9)), 50, 0.5).select(r6("threshold").alias("threshold"))


@query(f"""WITH {_HOT}, b AS (SELECT doc_id, round(score, 9) AS score, ((doc_id % 32) * {hotness.GOLDEN % 32}) % 32 AS bucket FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, doc_id) > 2 AS over_cap FROM b)
SELECT doc_id, bucket::INTEGER AS bucket, over_cap FROM r ORDER BY over_cap, score DESC, doc_id LIMIT 40""")
def diversity_topn(spark, sf):
    return hotness.diverse_top(_scores(spark, sf).withColumn("score", F.round("score", 9)), 40, 32).select("doc_id", "bucket", "over_cap")


@query(f"WITH {_HOT} SELECT doc_id, round(round(score, 9) / (1 + least(1.0, 0.35 * least(accesses % 12, 10))), 6) AS admission FROM s")
def admission_scores(spark, sf):
    return _scores(spark, sf).select("doc_id", r6(hotness.admission(F.round("score", 9), F.col("accesses") % 12)).alias("admission"))


@query("SELECT count(DISTINCT user_id) / count(*) AS diversity, count(*) AS accesses FROM events")
def log_diversity(spark, sf):
    return hotness.diversity(log(spark, sf))


@query("SELECT event_id, user_id AS doc_id FROM events ORDER BY event_id DESC LIMIT 500")
def ring_buffer(spark, sf):
    return hotness.ring_buffer(log(spark, sf), 500, "event_id").select("event_id", "doc_id")


def _ab(spark, sf):
    e = log(spark, sf)
    return e.select((F.col("event_id")).alias("timestamp_ms"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "lru_baseline").otherwise("learned_predictor").alias("strategy"), F.when(F.col("event_id") % 10 < 6, "hit").when(F.col("event_id") % 10 < 9, "miss").otherwise("eviction").alias("event_type"), "doc_id", (F.col("event_id") % 1000 + 100).alias("latency_ns"))


@query("""WITH m AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'lru_baseline' ELSE 'learned_predictor' END AS strategy, event_id % 10 AS k, event_id % 1000 + 100 AS ns FROM events)
SELECT strategy, count(*) FILTER (WHERE k < 6) AS hits, count(*) FILTER (WHERE k BETWEEN 6 AND 8) AS misses, count(*) AS events, count(*) FILTER (WHERE k < 6) / count(*) FILTER (WHERE k < 9) AS hit_rate,
CAST(floor(sum(ns) FILTER (WHERE k < 6) / count(*) FILTER (WHERE k < 6)) AS BIGINT) AS mean_hit_ns FROM m GROUP BY strategy""")
def ab_summary(spark, sf):
    return cache.ab_summary(_ab(spark, sf))


CACHES, CAPACITY = 4, 12


@query(f"""WITH a AS (SELECT event_id AS pos, user_id AS doc, user_id % {CACHES} AS cache_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
d AS (SELECT a.cache_id, a.pos, a.prev, count(DISTINCT b.doc) AS apart FROM a LEFT JOIN a b ON a.cache_id = b.cache_id AND b.pos > a.prev AND b.pos < a.pos GROUP BY a.cache_id, a.pos, a.prev)
SELECT cache_id, count(*) AS accesses, count(*) FILTER (WHERE prev IS NOT NULL AND apart < {CAPACITY}) AS hits FROM d GROUP BY cache_id""")
def lru_hit_rate(spark, sf):
    a = log(spark, sf).select(F.col("event_id").alias("pos"), "doc_id", (F.col("doc_id") % CACHES).alias("cache_id"))
    return cache.lru(a, CAPACITY).groupBy("cache_id").agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"))


_EVENTS = """e AS (SELECT *, user_id % {of} AS key, row_number() OVER (PARTITION BY user_id % {of} ORDER BY {order}) AS n FROM events)"""
_SAMPLE = " + ".join(f"(strpos('0123456789abcdef', substr(md5(CAST(user_id AS VARCHAR)), {i + 1}, 1)) - 1) * {16 ** (3 - i)}" for i in range(4))


@query(f"""WITH RECURSIVE {_HOT}, {_EVENTS.format(of=CACHES, order="event_id")},
x AS (SELECT e.key, n, user_id AS doc, coalesce(round(score, 9), 0) AS score, epoch_us(ts) >= (SELECT min(epoch_us(ts)) FROM events) + 864000000000 AS trained, ({_SAMPLE}) / 65535.0::DOUBLE AS at FROM e LEFT JOIN s ON e.user_id = s.doc_id),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, []::BIGINT[] AS held, false AS hit FROM x
UNION ALL SELECT key, n, CASE WHEN seen THEN list_append(list_filter(held, lambda y: y <> doc), doc) WHEN NOT ok THEN held WHEN len(held) >= {CAPACITY} THEN list_append(held[2:], doc) ELSE list_append(held, doc) END, seen
FROM (SELECT x.key, x.n, x.doc, f.held, list_contains(f.held, x.doc) AS seen, CASE WHEN x.trained THEN x.score >= 0.5 ELSE len(f.held) < {CAPACITY} OR x.at < {cache.SAMPLED} END AS ok FROM f JOIN x ON x.key = f.key AND x.n = f.n + 1))
SELECT key AS cache_id, count(*) AS accesses, count(*) FILTER (WHERE hit) AS hits FROM f WHERE n > 0 GROUP BY key""")
def learned_admission(spark, sf):
    """There is a model from the tenth day on."""
    l = log(spark, sf)
    start = F.unix_micros("ts") >= F.unix_micros("start") + 864_000_000_000
    a = hotness.one_row(l, l.agg(F.min("ts").alias("start"))).select(F.col("event_id").alias("pos"), "doc_id", (F.col("doc_id") % CACHES).alias("cache_id"), start.alias("trained"))
    s = _scores(spark, sf).select("doc_id", F.round("score", 9).alias("score"))
    return cache.learned(a.join(s, "doc_id", "left"), CAPACITY, 0.5).groupBy("cache_id").agg(F.count("*").alias("accesses"), F.count_if("hit").alias("hits"))


@query(f"""WITH RECURSIVE {_EVENTS.format(of=CACHES, order="ts, event_id")}, x AS (SELECT key, n, user_id // {CACHES} % 5 AS tenant, epoch_us(ts) / 86400000000 AS t FROM e),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS tenant, [10.0::DOUBLE, 10.0, 10.0, 10.0, 10.0] AS own, [NULL::DOUBLE, NULL, NULL, NULL, NULL] AS own_at, 40.0::DOUBLE AS every, NULL::DOUBLE AS every_at, false AS allowed FROM x
UNION ALL SELECT key, n, tenant, list_transform(own, lambda y, i: CASE WHEN i <> tenant + 1 THEN y WHEN NOT p THEN mine WHEN g THEN mine - 1 ELSE least(10.0, mine - 1 + 1) END), list_transform(own_at, lambda y, i: CASE WHEN i = tenant + 1 THEN t ELSE y END),
CASE WHEN p THEN whole - g::INT ELSE every END, CASE WHEN p THEN t ELSE every_at END, p AND g
FROM (SELECT *, mine >= 1 AS p, whole >= 1 AS g FROM (SELECT x.key, x.n, x.tenant, x.t, own, own_at, every, every_at, CASE WHEN own_at[x.tenant + 1] IS NULL THEN 10.0 ELSE least(10.0, own[x.tenant + 1] + (x.t - own_at[x.tenant + 1]) * 10.0) END AS mine,
CASE WHEN every_at IS NULL THEN 40.0 ELSE least(40.0, every + (x.t - every_at) * 40.0) END AS whole FROM f JOIN x ON x.key = f.key AND x.n = f.n + 1)))
SELECT key AS limiter, tenant, count(*) AS requests, count(*) FILTER (WHERE allowed) AS allowed FROM f WHERE n > 0 GROUP BY key, tenant""")
def rate_limited(spark, sf):
    """Ten requests a day for each tenant and forty for each limiter."""
    r = log(spark, sf).select((F.col("doc_id") % CACHES).alias("limiter"), (F.floor(F.col("doc_id") / CACHES) % 5).alias("tenant"), (F.unix_micros("ts") / 86_400_000_000).alias("t"), "event_id")
    out = cache.rate_limited(r, 10.0, 40.0, order=("t", "event_id"))
    return out.groupBy("limiter", "tenant").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


@query("""WITH RECURSIVE e AS (SELECT event_type AS service, epoch_us(ts) / 1000000 AS t, event_id % 3 <> 0 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT service, 0::BIGINT AS n, 'closed' AS state, 0 AS bad, 0 AS good, 0.0::DOUBLE AS since, min(t) AS begin, false AS refused FROM e GROUP BY service
UNION ALL SELECT service, n, CASE WHEN st = 'open' THEN 'open' WHEN st = 'half_open' THEN CASE WHEN NOT ok THEN 'open' WHEN g + 1 >= 2 THEN 'closed' ELSE 'half_open' END WHEN ok OR late OR bad + 1 < 2 THEN 'closed' ELSE 'open' END,
CASE WHEN st = 'open' THEN bad WHEN st = 'half_open' THEN CASE WHEN ok AND g + 1 >= 2 THEN 0 ELSE bad END WHEN ok THEN 0 WHEN late THEN 1 ELSE bad + 1 END,
CASE WHEN st = 'half_open' THEN g + ok::INT ELSE g END, CASE WHEN (st = 'half_open' AND NOT ok) OR (st = 'closed' AND NOT ok AND NOT late AND bad + 1 >= 2) THEN t ELSE since END,
CASE WHEN (st = 'half_open' AND ok AND g + 1 >= 2) OR (st = 'closed' AND (ok OR late)) THEN t ELSE begin END, st = 'open'
FROM (SELECT e.service, e.n, e.t, e.ok, f.bad, f.since, f.begin, e.t - f.begin >= 7200 AS late, CASE WHEN f.state = 'open' AND e.t - f.since >= 3600 THEN 'half_open' ELSE f.state END AS st, CASE WHEN f.state = 'open' AND e.t - f.since >= 3600 THEN 0 ELSE f.good END AS g
FROM f JOIN e ON e.service = f.service AND e.n = f.n + 1))
SELECT service, state, count(*) AS calls, count(*) FILTER (WHERE refused) AS refused FROM f WHERE n > 0 GROUP BY service, state""")
def circuit_states(spark, sf):
    c = log(spark, sf).select(F.col("event_type").alias("service"), (F.unix_micros("ts") / 1e6).alias("t"), (F.col("event_id") % 3 != 0).alias("ok"), "event_id")
    out = cache.circuit_breaker(c, failures=2, window_s=7200.0, open_s=3600.0, order=("t", "event_id"))
    return out.groupBy("service", "state").agg(F.count("*").alias("calls"), F.count_if("refused").alias("refused"))


def _results(spark, sf):
    """Documents of each source, judged by quality, in the order of their ids."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return d.select(F.col("source").alias("query_id"), "doc_id", place.alias("position"), (F.col("quality") * (1 + F.col("n_chars") % 3)).cast("double").alias("relevance"))


_RANKED = """r AS (SELECT d.source AS query_id, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS position, CAST(l.quality * (1 + d.n_chars % 3) AS DOUBLE) AS relevance FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) - 1 AS ideal FROM r),
n AS (SELECT query_id, sum(CASE WHEN position < 10 THEN relevance / log2(position + 2) ELSE 0 END) AS dcg, sum(CASE WHEN ideal < 10 THEN relevance / log2(ideal + 2) ELSE 0 END) AS idcg FROM i GROUP BY query_id)"""


@query(f"WITH {_RANKED} SELECT query_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM n")
def dcg_ndcg(spark, sf):
    return ranking.dcg(_results(spark, sf), 10).select("query_id", *(r6(c).alias(c) for c in ("dcg", "idcg", "ndcg")))


@query(f"WITH {_RANKED} SELECT query_id, round(coalesce(1.0 / (min(CASE WHEN relevance > 0 THEN position END) + 1), 0), 6) AS mrr, round(count(*) FILTER (WHERE position < 10 AND relevance > 0) / count(*) FILTER (WHERE relevance > 0), 6) AS recall FROM r GROUP BY query_id")
def mrr_recall(spark, sf):
    r = _results(spark, sf)
    totals = r.groupBy("query_id").agg(F.count_if(F.col("relevance") > 0).alias("total"))
    return ranking.mrr(r).join(ranking.recall(r, totals, 10), "query_id").select("query_id", r6("mrr").alias("mrr"), r6("recall").alias("recall"))


@query(f"WITH {_RANKED} SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS mean_ndcg, count(*) AS queries FROM n")
def mean_ndcg(spark, sf):
    return ranking.mean_ndcg(_results(spark, sf), 10).select(r6("mean_ndcg").alias("mean_ndcg"), "queries")


@query("""WITH s AS (SELECT event_type AS service, value AS latency_ms, event_id % 4 <> 0 AS hit, event_id % 500 = 0 AS error FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY service) AS n FROM s),
a AS (SELECT service, count(*) AS total, max(CASE WHEN i = least(floor(0.99 * n), n - 1) THEN latency_ms END) AS p99, avg(hit::INT) AS hit_rate, avg(error::INT) AS error_rate FROM r GROUP BY service)
SELECT service, total, round(p99, 6) AS p99, round(hit_rate, 6) AS hit_rate, round(1 - error_rate, 6) AS availability, ((p99 > 10)::INT + (hit_rate < 0.7)::INT + (error_rate > 0.001)::INT + (1 - error_rate < 0.999)::INT)::INTEGER AS breaches FROM a""")
def slo_status(spark, sf):
    s = log(spark, sf).select(F.col("event_type").alias("service"), F.col("value").alias("latency_ms"), (F.col("event_id") % 4 != 0).alias("hit"), (F.col("event_id") % 500 == 0).alias("error"))
    return ops.slo(s, least=1).select("service", "total", r6("p99").alias("p99"), r6("hit_rate").alias("hit_rate"), r6("availability").alias("availability"), "breaches")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(CASE WHEN i = least(floor(0.5 * n), n - 1) THEN value END), 6) AS p50, round(max(CASE WHEN i = least(floor(0.9 * n), n - 1) THEN value END), 6) AS p90, round(max(CASE WHEN i = least(floor(0.99 * n), n - 1) THEN value END), 6) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf):
    return hotness.nearest_rank(log(spark, sf), ["event_type"], "value", [50, 90, 99]).select("event_type", *(r6(p).alias(p) for p in ("p50", "p90", "p99")))


def _usage(spark, sf):
    op = F.element_at(F.array(F.lit("query"), F.lit("insert"), F.lit("delete")), (F.col("event_id") % 3 + 1).cast("int"))
    return log(spark, sf).select((F.col("doc_id") % 10).alias("tenant"), op.alias("op"), "doc_id", F.col("event_id").alias("seq"))


_USAGE = "u AS (SELECT user_id % 10 AS tenant, event_id % 3 AS k, user_id AS doc_id, event_id AS seq FROM events)"


@query(f"WITH {_USAGE} SELECT tenant, count(*) FILTER (WHERE k = 0) AS query_count, count(*) FILTER (WHERE k = 1) AS insert_count, count(*) FILTER (WHERE k = 2) AS delete_count, count(*) AS billable_events FROM u GROUP BY tenant")
def usage_by_tenant(spark, sf):
    return ops.usage(_usage(spark, sf))


@query(f"""WITH {_USAGE}, s AS (SELECT tenant, seq, sum(CASE k WHEN 1 THEN 2 WHEN 2 THEN -3 ELSE 0 END) OVER (PARTITION BY tenant ORDER BY seq) AS p FROM u)
SELECT tenant, seq, CAST(p - least(0, min(p) OVER (PARTITION BY tenant ORDER BY seq)) AS BIGINT) AS value FROM s""")
def usage_saturating(spark, sf):
    e = _usage(spark, sf).withColumn("delta", F.when(F.col("op") == "insert", 2).when(F.col("op") == "delete", -3).otherwise(0))
    return ops.saturating(e, "tenant", "seq", "delta").select("tenant", "seq", "value")


@query(f"""WITH {_USAGE}, f AS (SELECT tenant, doc_id, min(seq) AS first FROM u WHERE k = 1 GROUP BY tenant, doc_id), p AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY first) AS place FROM f)
SELECT u.tenant, u.doc_id, u.seq, p.place <= 8 AS accepted FROM u JOIN p ON u.tenant = p.tenant AND u.doc_id = p.doc_id WHERE u.k = 1""")
def quota(spark, sf):
    return ops.quota(_usage(spark, sf).where("op = 'insert'").drop("op"), 8)


_BACKUPS = "b AS (SELECT event_id AS id, CASE WHEN event_id % 50 <> 0 THEN event_id - 1 END AS parent_id, epoch_us(ts) // 1000000 AS ts, CASE WHEN event_id % 50 = 0 THEN 'full' ELSE 'incremental' END AS kind FROM events), m AS (SELECT max(ts) AS now FROM b)"


def _backups(spark, sf):
    e = log(spark, sf)
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 50 != 0, F.col("event_id") - 1).alias("parent_id"), F.unix_seconds("ts").alias("ts"), F.when(F.col("event_id") % 50 == 0, "full").otherwise("incremental").alias("kind"))


@query(f"""WITH {_BACKUPS}, c AS (SELECT id, ts, now - ts AS age, CASE WHEN now - ts < 86400 THEN 'hourly' WHEN now - ts < 604800 THEN 'daily' WHEN now - ts < 2419200 THEN 'weekly' WHEN now - ts < 31104000 THEN 'monthly' ELSE 'expired' END AS class,
CASE WHEN now - ts < 86400 THEN ts // 3600 WHEN now - ts < 604800 THEN ts // 86400 WHEN now - ts < 2419200 THEN ts // 604800 WHEN now - ts < 31104000 THEN ts // 2592000 ELSE -1 END AS bucket FROM b, m),
r AS (SELECT *, row_number() OVER (PARTITION BY class, bucket ORDER BY ts DESC, id DESC) AS k FROM c)
SELECT id, class, CAST(bucket AS BIGINT) AS bucket, (k = 1 AND class <> 'expired') OR age < 7200 AS keep FROM r""")
def retention(spark, sf):
    b = _backups(spark, sf)
    now = b.agg(F.max("ts")).first()[0]
    return ops.retention(b, now, least_age=7200).select("id", "class", "bucket", "keep")


@query(f"""WITH RECURSIVE {_BACKUPS}, c AS (SELECT id, parent_id, ts, kind, 0 AS step FROM (SELECT b.* FROM b, m WHERE kind = 'full' AND ts <= now - 864000 ORDER BY ts DESC, id DESC LIMIT 1)
UNION ALL SELECT b.id, b.parent_id, b.ts, b.kind, c.step + 1 FROM b JOIN c ON b.parent_id = c.id JOIN m ON b.ts <= now - 864000)
SELECT id, kind, CAST(step AS INTEGER) AS step FROM c""")
def pitr_chain(spark, sf):
    b = _backups(spark, sf)
    return ops.chain(b, b.agg(F.max("ts")).first()[0] - 864000).select("id", "kind", F.col("step").cast("int").alias("step"))


@query("""WITH w AS (SELECT user_id AS doc_id, ts, unnest(range(24)) AS k FROM events),
s AS (SELECT doc_id, ts, to_timestamp((epoch_us(ts) // 3600000000 - k) * 3600) AS start FROM w)
SELECT doc_id, CAST(epoch_us(start) // 1000000 AS BIGINT) AS start_s, count(*) AS accesses FROM s GROUP BY doc_id, start""")
def window_counts(spark, sf):
    return jobs.windowed_counts(log(spark, sf), "24 hours", "1 hour").select("doc_id", F.unix_seconds("start").alias("start_s"), "accesses")


THRESHOLDS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query(f"""WITH {CORPUS}, e AS (SELECT e.vec_id, label FROM embeddings e), p AS (SELECT query_id, doc_id, e.label = c.label AS same, {DOT} AS cos FROM q JOIN e ON q.query_id = e.vec_id JOIN c ON q.query_id <> c.doc_id),
t AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS threshold)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(count(*) FILTER (WHERE same AND cos >= threshold) / count(*) FILTER (WHERE same), 6) AS tpr, round(count(*) FILTER (WHERE NOT same AND cos >= threshold) / count(*) FILTER (WHERE NOT same), 6) AS fpr FROM p, t GROUP BY threshold""")
def threshold_roc(spark, sf):
    """The stated queries against all rows: how often a cosine reaches each threshold, by equal and different labels."""
    q = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    rate = lambda same: r6(F.max(F.when(same, F.col("hits") / F.col("pairs"))))
    return knn.threshold_counts(vectors(spark, sf), q, THRESHOLDS).groupBy("threshold").agg(rate(F.col("same")).alias("tpr"), rate(~F.col("same")).alias("fpr"))


@query(f"""WITH u AS (SELECT label, vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
t AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM u GROUP BY label, i)
SELECT label, max(n) AS n, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1.0)), 6) AS similarity FROM t GROUP BY label""")
def cluster_similarity(spark, sf):
    """Mean cosine within each label without the diagonal, from sums: |sum x|^2 is the sum of all products."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode(V.as_double(F.col("embedding"))).alias("i", "x"))
    t = e.groupBy("label", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    return t.groupBy("label").agg(F.max("n").alias("n"), r6((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / (F.max("n") * (F.max("n") - 1.0))).alias("similarity"))


@query(f"""WITH e AS (SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c AS (SELECT vec_id AS cache_id, label AS scope, vec_id AS hash, vec_id % 15 AS k, v AS b FROM e WHERE vec_id % 100 <> 0),
h AS (SELECT scope, min(hash) FILTER (WHERE k >= 5) AS enough, min(hash) FILTER (WHERE k < 5) AS small FROM c GROUP BY scope),
q AS (SELECT vec_id AS query_id, label AS scope, coalesce(CASE vec_id // 100 % 3 WHEN 0 THEN enough WHEN 1 THEN small END, vec_id) AS hash, v AS a FROM e LEFT JOIN h ON e.label = h.scope WHERE vec_id % 100 = 0),
x AS (SELECT q.query_id, q.scope, q.a, c.cache_id AS same, c.k AS has FROM q LEFT JOIN c ON q.scope = c.scope AND q.hash = c.hash),
s AS (SELECT query_id, cache_id, round({DOT}, 12) AS sim FROM x JOIN c ON x.scope = c.scope AND c.k >= 5 WHERE same IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, cache_id DESC) AS n FROM s WHERE sim > 0.2)
SELECT x.query_id, CASE WHEN has >= 5 THEN same ELSE r.cache_id END AS cache_id, CASE WHEN has >= 5 THEN 'exact' WHEN r.cache_id IS NULL THEN 'miss' ELSE 'similar' END AS path, round(r.sim, 6) AS sim FROM x LEFT JOIN r ON x.query_id = r.query_id AND r.n = 1""")
def query_cache_lookup(spark, sf):
    """Every row that isn't asked is an entry. A third of the queries repeat an entry of their scope with enough k, a third one with too small a k."""
    e = table(spark, sf, "embeddings")
    c = e.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("cache_id"), F.col("label").alias("scope"), F.col("vec_id").alias("hash"), (F.col("vec_id") % 15).alias("k"), "embedding", F.col("vec_id").alias("seq"))
    first = lambda ok: F.min(F.when(ok, F.col("hash")))
    h = c.groupBy("scope").agg(first(F.col("k") >= 5).alias("enough"), first(F.col("k") < 5).alias("small"))
    third = F.floor(F.col("vec_id") / 100) % 3
    q = e.where("vec_id % 100 = 0").withColumn("scope", F.col("label")).join(h, "scope", "left")
    a = q.select(F.col("vec_id").alias("query_id"), "scope", F.coalesce(F.when(third == 0, F.col("enough")).when(third == 1, F.col("small")), F.col("vec_id")).alias("hash"), F.lit(5).alias("k"), "embedding")
    return cache.query_cache_lookup(a, c, threshold=0.2, scan_limit=1 << 30).withColumn("sim", r6("sim"))


@query(f"""WITH {CORPUS}, d AS (SELECT query_id, doc_id, round({COS}, 12) AS distance FROM q CROSS JOIN c WHERE label < 8), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS k FROM d),
w AS (SELECT query_id, max(distance) AS worst, count(*) AS n FROM r WHERE k <= {K} GROUP BY query_id)
SELECT DISTINCT q.query_id AS cache_id FROM q JOIN w ON q.query_id = w.query_id JOIN c ON c.label >= 8 AND (n < {K} OR round({COS}, 12) <= worst)""")
def query_cache_invalidate(spark, sf):
    c, q = vectors(spark, sf), asked(spark, sf)
    results = knn.knn(c.where("label < 8"), q, K).select(F.col("query_id").alias("cache_id"), "distance")
    cached = q.select(F.col("query_id").alias("cache_id"), F.lit(K).alias("k"), "embedding")
    return cache.invalidated(results, cached, c.where("label >= 8"))


@query(f"WITH {CORPUS}, d AS (SELECT query_id, doc_id, round({COS}, 12) AS distance, label FROM q CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS k FROM d) SELECT DISTINCT query_id AS cache_id FROM r WHERE k <= {K} AND label = 9")
def query_cache_invalidate_docs(spark, sf):
    c = vectors(spark, sf)
    results = knn.knn(c, asked(spark, sf), K).select(F.col("query_id").alias("cache_id"), "doc_id")
    return cache.invalidated_by_docs(results, c.where("label = 9"))


@query(f"WITH {CORPUS}, d AS (SELECT query_id, doc_id, round({COS}, 12) AS distance FROM q CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank FROM d) SELECT query_id, doc_id, rank FROM r WHERE rank <= 5")
def served_accesses(spark, sf):
    """The first results of each search, as they go to the access log."""
    return knn.knn(vectors(spark, sf), asked(spark, sf), K).where("rank <= 5").select("query_id", "doc_id", "rank")


@query("SELECT vec_id AS doc_id, (CASE WHEN label = 1 THEN 0 WHEN label < 3 THEN 1 ELSE 2 END)::INTEGER AS tier FROM embeddings")
def tier_lookup(spark, sf):
    """Cache before hot tier before cold tier."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return merge.by_precedence([e.where("label = 1"), e.where("label < 3"), e]).select("doc_id", "tier")


@query(f"""WITH {_HOT}, r AS (SELECT round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 9)) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT count(*) AS tracked, count(*) FILTER (WHERE score > 0.5) AS hot, round(avg(score), 6) AS mean, {', '.join(f"round(max(CASE WHEN i = floor({p / 100} * (n - 1) + 0.5) THEN score END), 6) AS p{p}" for p in (50, 90, 99))} FROM r""")
def predictor_stats(spark, sf):
    out = hotness.predictor_stats(_scores(spark, sf).withColumn("score", F.round("score", 9)), 0.5)
    return out.select("tracked", "hot", *(r6(c).alias(c) for c in ("mean", "p50", "p90", "p99")))


@query(f"""WITH {_HOT}, c AS (SELECT round(score, 9) >= 0.5 AS p, accesses >= 3 AS a FROM s)
SELECT count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM c""")
def prediction_confusion(spark, sf):
    return hotness.confusion(_scores(spark, sf).select((F.round("score", 9) >= 0.5).alias("predicted"), (F.col("accesses") >= 3).alias("actual")))


@query(f"""WITH {_HOT}, f AS (SELECT user_id AS d, count(*) FILTER (WHERE event_id % 7 = 0) AS fp, count(*) FILTER (WHERE event_id % 5 = 0) AS fn, count(*) % 10 AS streak FROM events GROUP BY user_id),
x AS (SELECT *, CASE WHEN fp > 0 THEN greatest(0.05, score - least(0.55, 0.15 * fp * (0.5 + 0.5 * greatest(0.1, exp(-0.5))))) ELSE score END AS a FROM s JOIN f ON s.doc_id = f.d),
y AS (SELECT *, CASE WHEN fn > 0 THEN least(1.0, a + least(0.20, 0.02 * fn)) ELSE a END AS b FROM x)
SELECT doc_id, round(CASE WHEN streak >= 6 THEN greatest(0.05, b / (1 + 0.35 * least(streak, 64))) ELSE b END, 6) AS score FROM y""")
def feedback_corrections(spark, sf):
    n = lambda k: F.count_if(F.col("event_id") % k == 0)
    feedback = log(spark, sf).groupBy("doc_id").agg(n(7).alias("fp"), F.lit(30.0).alias("fp_age_s"), n(5).alias("fn"), (F.count("*") % 10).alias("streak"))
    return hotness.corrected(_scores(spark, sf), feedback, 0.05).select("doc_id", r6("score").alias("score"))


@query(f"WITH {_USAGE} SELECT count(*) FILTER (WHERE k = 0) AS query_count, count(*) FILTER (WHERE k = 1) AS insert_count, count(*) FILTER (WHERE k = 2) AS delete_count, count(*) AS billable_events, count(DISTINCT tenant) AS tenants FROM u")
def usage_totals(spark, sf):
    u = ops.usage(_usage(spark, sf))
    return u.agg(*(F.sum(c).alias(c) for c in ("query_count", "insert_count", "delete_count", "billable_events")), F.count("*").alias("tenants"))


@query("SELECT CAST(o_orderkey // 1000 AS BIGINT) AS segment, max(o_orderkey) AS max_seq FROM orders GROUP BY 1 HAVING max(o_orderkey) > 3000")
def wal_segments_kept(spark, sf):
    segments = _changes(spark, sf).groupBy(F.floor(F.col("seq") / 1000).alias("segment")).agg(F.max("seq").alias("max_seq"))
    return store.kept_segments(segments, 3000)


@query(f"""WITH {_HOT}, c AS (SELECT doc_id, round(score, 9) AS f, CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 37 % 101) / 101.0::DOUBLE END AS l FROM s),
y AS (SELECT *, least(1.0, greatest(0.0, 0.55::DOUBLE * f + 0.45::DOUBLE * least(1.0, greatest(0.0, (l - 0.35::DOUBLE) / 0.65::DOUBLE)) + CASE WHEN l >= 0.96 THEN 0.06 WHEN l >= 0.8 THEN 0.02 ELSE 0 END)) AS score FROM c)
SELECT doc_id, round(CASE WHEN l IS NOT NULL THEN score END, 6) AS score, CASE WHEN f >= 0.75 THEN true WHEN l IS NULL THEN f > 0.5 WHEN l < 0.38 AND f <= 0.375 THEN false ELSE score >= 0.5 END AS admitted FROM y""")
def semantic_admission(spark, sf):
    likeness = F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") * 37 % 101) / F.lit(101.0))
    s = _scores(spark, sf).select("doc_id", F.round("score", 9).alias("f"), likeness.alias("l"))
    return s.select("doc_id", F.when(F.col("l").isNotNull(), r6(cache.semantic_score(F.col("f"), F.col("l")))).alias("score"), cache.semantic_admission(F.col("f"), F.col("l"), 0.5).alias("admitted"))


@query(f"""WITH RECURSIVE h AS (SELECT user_id % {CACHES} AS cache_id, epoch_us(ts) // 3600000000 AS pos, event_id % 10 AS i FROM events),
a AS (SELECT cache_id, pos, count(*) FILTER (WHERE i < 5) AS hits, count(*) FILTER (WHERE i >= 5) AS misses, count(*) FILTER (WHERE i >= 7) AS evictions, count(*) FILTER (WHERE i >= 6) AS insertions, count(*) FILTER (WHERE i = 1) AS fp, count(*) FILTER (WHERE i = 2) AS fn, count(*) FILTER (WHERE i = 3) AS streak FROM h GROUP BY cache_id, pos),
w AS (SELECT *, least({CAPACITY}, sum(insertions) OVER (PARTITION BY cache_id ORDER BY pos)) / {CAPACITY}::DOUBLE AS used, row_number() OVER (PARTITION BY cache_id ORDER BY pos) AS n FROM a),
g AS (SELECT cache_id, pos, n, used, CASE WHEN n > 1 AND insertions >= 8 THEN least(1.0::DOUBLE, evictions / insertions) ELSE 0.0::DOUBLE END AS pressure, CASE WHEN n > 1 AND hits + misses >= 32 THEN least(1.0::DOUBLE, misses / (hits + misses)) ELSE 0.0::DOUBLE END AS missed,
 CASE WHEN fn + 0.5::DOUBLE * streak + fp < 4 THEN 0.0::DOUBLE ELSE (fp - (fn + 0.5::DOUBLE * streak)) / (fn + 0.5::DOUBLE * streak + fp) END AS feedback, used - 0.9::DOUBLE AS off FROM w),
o AS (SELECT cache_id, pos, n, 0.18::DOUBLE * least(1.0, greatest(-1.0, 0.6::DOUBLE * CASE WHEN abs(off) <= 0.03::DOUBLE THEN 0.0::DOUBLE WHEN off > 0 THEN least(1.0, off / (1 - 0.9::DOUBLE)) ELSE greatest(-1.0, off / 0.9::DOUBLE) END + 0.25::DOUBLE * feedback + 0.15::DOUBLE * pressure
 - CASE WHEN used < 0.9::DOUBLE - 0.03::DOUBLE AND missed > 0.35::DOUBLE THEN 0.1::DOUBLE * (missed - 0.35::DOUBLE) / (1 - 0.35::DOUBLE) ELSE 0.0::DOUBLE END)) AS goal FROM g),
f AS (SELECT DISTINCT cache_id, NULL::BIGINT AS pos, 0::BIGINT AS n, 0.0::DOUBLE AS bias FROM o
UNION ALL SELECT o.cache_id, o.pos, o.n, least(0.18, greatest(-0.18, f.bias + least(0.063::DOUBLE, greatest(-0.063::DOUBLE, o.goal - f.bias)))) FROM f JOIN o ON o.cache_id = f.cache_id AND o.n = f.n + 1)
SELECT cache_id, pos, round(bias, 6) AS bias FROM f WHERE n > 0""")
def admission_bias(spark, sf):
    """Hours are the intervals; a limited step is a fold."""
    n = lambda c, name: F.count_if(c).alias(name)
    i = F.col("event_id") % 10
    e = log(spark, sf).groupBy((F.col("doc_id") % CACHES).alias("cache_id"), F.floor(F.unix_seconds("ts") / 3600).alias("pos")).agg(n(i < 5, "hits"), n(i >= 5, "misses"), n(i >= 7, "evictions"), n(i >= 6, "insertions"), n(i == 1, "fp"), n(i == 2, "fn"), n(i == 3, "streak"))
    running = Window.partitionBy("cache_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({c: F.sum(c).over(running) for c in ("hits", "misses", "evictions", "insertions")})
    e = e.withColumns({"size": F.least(F.lit(CAPACITY), F.col("insertions")), "capacity": F.lit(CAPACITY)})
    return cache.admission_bias(e).select("cache_id", "pos", r6("bias").alias("bias"))


@query("""SELECT CASE WHEN vec_id < 4 THEN 'doc_id must be at least 1' WHEN label = 9 THEN 'embedding is empty' WHEN label = 8 THEN 'embedding has another dimension' ELSE 'accepted' END AS status, count(*) AS n FROM embeddings GROUP BY 1""")
def load_report(spark, sf):
    """A bulk load in which some ids are too small and some vectors are empty or cut."""
    cut = F.when(F.col("label") == 9, F.slice("embedding", 1, 0)).when(F.col("label") == 8, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return store.load_report(table(spark, sf, "embeddings").select((F.col("vec_id") - 3).alias("doc_id"), cut.alias("embedding")), 64)


@query("""SELECT count(*) AS total_queries, count(*) FILTER (WHERE k < 3) AS cache_hits, count(*) FILTER (WHERE k = 3) AS query_cache_hits, count(*) FILTER (WHERE k IN (4, 5)) AS hot_hits, count(*) FILTER (WHERE k > 5) AS cold_searches,
round(avg((k < 3)::INT), 6) AS cache_hit_rate, round(avg((k = 3)::INT), 6) AS query_cache_hit_rate, round(avg((k < 4)::INT), 6) AS l1_hit_rate, round(avg((k < 6)::INT), 6) AS overall_hit_rate FROM (SELECT user_id % 8 AS k FROM events)""")
def tier_stats(spark, sf):
    k = F.col("doc_id") % 8
    tier = F.when(k < 3, "cache").when(k == 3, "query_cache").when(k < 6, "hot").otherwise("cold")
    out = ops.tier_stats(log(spark, sf).select(tier.alias("tier")))
    return out.select(*(r6(c).alias(c) if c.endswith("rate") else c for c in out.columns))


@query(f"""WITH p AS ({ORACLE_SQL["query_cache_lookup"]}) SELECT count(*) FILTER (WHERE path = 'exact') AS exact_hits, count(*) FILTER (WHERE path = 'similar') AS similarity_hits, count(*) FILTER (WHERE path = 'miss') AS misses,
round(coalesce(avg(sim) FILTER (WHERE path = 'similar'), 0), 6) AS avg_similarity, count(*) FILTER (WHERE path <> 'miss') AS total_hits, round(avg((path <> 'miss')::INT), 6) AS hit_rate FROM p""")
def query_cache_stats(spark, sf):
    out = cache.query_cache_stats(query_cache_lookup(spark, sf))
    return out.select(*(r6(c).alias(c) if c in ("avg_similarity", "hit_rate") else c for c in out.columns))


@query(f"""WITH {_HOT}, x AS (SELECT doc_id, round(score, 9) / (1 + least(1.0, 0.35 * least(accesses % 12, 10))) AS admission, accesses FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY round(admission, 9) DESC, accesses DESC, doc_id) - 1 AS i, row_number() OVER (ORDER BY accesses DESC, doc_id) - 1 AS t FROM x)
SELECT round(sum(CASE WHEN i < 10 THEN accesses / log2(i + 2) ELSE 0 END) / sum(CASE WHEN t < 10 THEN accesses / log2(t + 2) ELSE 0 END), 6) AS ndcg, round(1.0::DOUBLE / (1 + min(i) FILTER (WHERE t < 10)), 6) AS mrr, round(count(*) FILTER (WHERE i < 10 AND t < 10) / count(*) FILTER (WHERE t < 10), 6) AS recall FROM r""")
def predictor_quality(spark, sf):
    admission = F.round(hotness.admission(F.round("score", 9), F.col("accesses") % 12), 9)
    return ranking.predictor_quality(_scores(spark, sf).select("doc_id", admission.alias("admission"), "accesses")).select(*(r6(c).alias(c) for c in ("ndcg", "mrr", "recall")))


@query("""WITH e AS (SELECT epoch_us(ts) AS t FROM events), m AS (SELECT min(t) AS a, (max(t) - min(t)) // 21600000000 AS last FROM e), k AS (SELECT unnest(range(1, (SELECT last FROM m) + 1)) AS cycle)
SELECT cycle, count(t) AS events, count(t) >= 60 AS trained FROM k CROSS JOIN m LEFT JOIN e ON t <= a + cycle * 21600000000 AND t >= a + cycle * 21600000000 - 86400000000 GROUP BY cycle""")
def training_cycles(spark, sf):
    """Every six hours over the day before."""
    return hotness.training_cycles(log(spark, sf), 21_600, 86_400, 60)


@query("""WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'bad_' ELSE 'key_' END AS p, CASE WHEN c_custkey % 5 = 0 THEN 'a-b' ELSE 'tenant_' || (c_custkey % 10) END AS t, CASE WHEN c_custkey % 6 = 0 THEN left(md5(CAST(c_custkey AS VARCHAR)), 28) ELSE md5(CAST(c_custkey AS VARCHAR)) END AS s FROM customer),
j AS (SELECT *, CASE WHEN p = 'bad_' THEN 'prefix' WHEN length(p || t || '_' || s) < 38 THEN 'too short' WHEN t = 'a-b' THEN 'tenant' WHEN length(s) < 32 THEN 'secret too short' END AS problem FROM k)
SELECT c_custkey::BIGINT AS id, CASE WHEN problem IS NULL THEN t END AS tenant, p || t || '_<redacted>' AS redacted, problem FROM j""")
def api_keys(spark, sf):
    c = F.col("c_custkey").cast("long")
    md5 = F.md5(c.cast("string"))
    tenant = F.when(c % 5 == 0, "a-b").otherwise(F.concat(F.lit("tenant_"), (c % 10).cast("string")))
    key = F.concat(F.when(c % 7 == 0, "bad_").otherwise("key_"), tenant, F.lit("_"), F.when(c % 6 == 0, F.left(md5, F.lit(28))).otherwise(md5))
    tenant, redacted, problem = ops.api_key(F.col("key"), "key_")
    return table(spark, sf, "customer").select(c.alias("id"), key.alias("key")).select("id", tenant.alias("tenant"), redacted.alias("redacted"), problem.alias("problem"))


_MESSAGES = ("Search timed out after 5 s", "TIMEOUT in cold tier", "executor saturated", "max in-flight searches reached", "invalid metric", "query cannot be empty", "k must be greater than 0", "disk failure")


@query(f"""WITH m AS (SELECT event_id, ([{", ".join(f"'{m}'" for m in _MESSAGES)}])[event_id % 8 + 1] AS t FROM events)
SELECT CASE WHEN regexp_matches(t, 'timed out|timeout', 'i') THEN 'timeout' WHEN regexp_matches(t, 'saturated|resource exhausted|max in-flight', 'i') THEN 'resource_exhausted' WHEN regexp_matches(t, 'invalid|dimension mismatch|cannot be empty|must be', 'i') THEN 'validation' ELSE 'internal' END AS kind, count(*) AS n FROM m GROUP BY 1""")
def error_classes(spark, sf):
    message = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    return log(spark, sf).groupBy(ops.error_class(message).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH s AS ({ORACLE_SQL["slo_status"]}), f AS (SELECT event_type AS service, count(*) FILTER (WHERE event_id % 3 = 0 AND value > 50) AS failed, max(event_id) % 2 = 1 AS broken FROM events GROUP BY event_type)
SELECT s.service, CASE WHEN broken THEN 'unhealthy' WHEN failed > 0 AND breaches = 0 THEN 'degraded' WHEN breaches = 0 THEN 'healthy' WHEN breaches = 1 THEN 'degraded' ELSE 'unhealthy' END AS health FROM s JOIN f ON s.service = f.service""")
def health_states(spark, sf):
    """Health by service, where the log of some is inconsistent and of others had failed writes."""
    f = log(spark, sf).groupBy(F.col("event_type").alias("of")).agg(F.count_if((F.col("event_id") % 3 == 0) & (F.col("value") > 50)).alias("failed"), (F.max("event_id") % 2 == 1).alias("broken"))
    return slo_status(spark, sf).join(f, F.col("service") == F.col("of")).select("service", ops.health(F.col("breaches"), F.col("broken"), F.col("failed")).alias("health"))


@query("""SELECT 0 AS ord, '# HELP accesses_total Accesses of each kind' AS line UNION ALL SELECT 1, '# TYPE accesses_total counter'
UNION ALL SELECT 2, 'accesses_total{kind="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type""")
def metrics_text(spark, sf):
    counts = log(spark, sf).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return ops.metrics_text(counts, "accesses_total", "counter", "Accesses of each kind", "kind", "n")


@query("SELECT doc_id % 3 AS tenant, count(DISTINCT lang || '/' || source) AS scopes FROM documents GROUP BY 1")
def search_scopes(spark, sf):
    d, tenant = table(spark, sf, "documents"), (F.col("doc_id") % 3).alias("tenant")
    return d.select(tenant, scope(F.col("doc_id") % 3, F.col("lang"), F.col("source")).alias("scope")).groupBy("tenant").agg(F.count_distinct("scope").alias("scopes"))


@query("SELECT lang || ':' || doc_id AS id, n_chars FROM documents WHERE lang = 'en'")
def tenant_prefix(spark, sf):
    d = table(spark, sf, "documents").select(F.concat_ws(":", "lang", F.col("doc_id").cast("string")).alias("id"), "n_chars")
    return of_tenant(d, "en")


@query("SELECT event_id, user_id AS doc_id FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 86400000000")
def recent_accesses(spark, sf):
    l = log(spark, sf)
    return hotness.recent(l, hotness.newest(l), 86400).select("event_id", "doc_id")


@query("SELECT CAST(o_orderkey // 1000 AS BIGINT) AS segment, max(o_orderkey) AS max_seq FROM orders GROUP BY 1 HAVING max(o_orderkey) >= 3000")
def incremental_segments(spark, sf):
    """The log segments that a full backup of those below 3,000 lacks."""
    segments = _changes(spark, sf).groupBy(F.floor(F.col("seq") / 1000).alias("segment")).agg(F.max("seq").alias("max_seq"))
    return merge.new_segments(segments, segments.where("max_seq < 3000")).select("segment", "max_seq")


@query(f"""WITH RECURSIVE {_EVENTS.format(of=CACHES, order="ts, user_id, event_id")}, x AS (SELECT key, n, user_id AS doc, epoch_us(ts) / 1000000 AS t FROM e),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, []::STRUCT(d BIGINT, t DOUBLE)[] AS held, NULL::DOUBLE AS last, NULL::DOUBLE AS at, 0::BIGINT AS size, false AS drained, false AS emergency FROM x
UNION ALL SELECT key, n, list_append(list_filter(h2, lambda y: y.d <> doc), {{'d': doc, 't': t}}), CASE WHEN em THEN t ELSE l1 END, t, 1 + len(list_filter(h2, lambda y: y.d <> doc)), dr OR em, em
FROM (SELECT *, len(h1) >= 24 AS em, CASE WHEN len(h1) >= 24 THEN [] ELSE h1 END AS h2 FROM (SELECT *, coalesce(tick <= t, false) AS dr, CASE WHEN tick <= t THEN [] ELSE held END AS h1, CASE WHEN tick <= t THEN tick ELSE last END AS l1
FROM (SELECT x.key, x.n, x.doc, x.t, f.held, f.last, CASE WHEN len(f.held) = 0 THEN NULL WHEN len(f.held) >= 20 THEN (floor(f.at / 21600) + 1) * 21600 ELSE greatest((floor(f.at / 21600) + 1) * 21600, ceil((coalesce(f.last, f.held[1].t) + 86400) / 21600) * 21600) END AS tick
FROM f JOIN x ON x.key = f.key AND x.n = f.n + 1))))
SELECT key AS tier_id, count(*) AS inserts, count(*) FILTER (WHERE drained) AS drains, count(*) FILTER (WHERE emergency) AS emergencies, max(size) AS largest FROM f WHERE n > 0 GROUP BY key""")
def hot_tier_flushes(spark, sf):
    """Looked at every six hours; at 24 documents the next insert drains the tier first."""
    a = log(spark, sf).select("doc_id", (F.col("doc_id") % CACHES).alias("tier_id"), (F.unix_micros("ts") / 1e6).alias("t"), "event_id")
    out = cache.flushes(a, 20, 86400.0, every_s=21600.0, hard=24, order=("t", "doc_id", "event_id"))
    return out.groupBy("tier_id").agg(F.count("*").alias("inserts"), F.count_if("drained").alias("drains"), F.count_if("emergency").alias("emergencies"), F.max("size").alias("largest"))


@query(f"""WITH RECURSIVE {_EVENTS.format(of=CACHES, order="event_id")},
x AS (SELECT key, n, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'lookup' ELSE 'insert' END AS op, user_id AS entry, event_id % 15 + 1 AS k, CASE WHEN event_id % 5 = 0 THEN event_id // 400 END AS seen FROM e),
f AS (SELECT DISTINCT key, 0::BIGINT AS n, []::STRUCT(e BIGINT, k BIGINT)[] AS held, 0::BIGINT AS generation, NULL::VARCHAR AS outcome, NULL::BIGINT AS evicted FROM x
UNION ALL SELECT key, n, CASE WHEN outcome = 'cleared' THEN [] WHEN outcome IN ('miss', 'too_small', 'skipped') THEN held WHEN outcome = 'hit' THEN list_append(rest, {{'e': entry, 'k': has}}) WHEN outcome IN ('updated', 'kept') THEN list_append(rest, {{'e': entry, 'k': greatest(has, k)}})
 WHEN len(held) >= {CAPACITY} THEN list_append(held[2:], {{'e': entry, 'k': k}}) ELSE list_append(held, {{'e': entry, 'k': k}}) END, generation + (outcome = 'cleared')::INT, outcome, CASE WHEN outcome = 'inserted' AND len(held) >= {CAPACITY} THEN held[1].e END
FROM (SELECT *, CASE WHEN op = 'clear' THEN 'cleared' WHEN op = 'lookup' THEN CASE WHEN has IS NULL THEN 'miss' WHEN has < k THEN 'too_small' ELSE 'hit' END WHEN seen <> generation THEN 'skipped' WHEN has IS NULL THEN 'inserted' WHEN k >= has THEN 'updated' ELSE 'kept' END AS outcome
FROM (SELECT x.*, f.held, f.generation, list_filter(f.held, lambda y: y.e <> x.entry) AS rest, list_filter(f.held, lambda y: y.e = x.entry)[1].k AS has FROM f JOIN x ON x.key = f.key AND x.n = f.n + 1)))
SELECT key AS cache_id, outcome, count(*) AS n, count(evicted) AS evictions, coalesce(sum(evicted), 0)::BIGINT AS evicted FROM f WHERE n > 0 GROUP BY key, outcome""")
def query_cache_inserts(spark, sf):
    i = F.col("event_id")
    op = F.when(i % 97 == 0, "clear").when(i % 3 == 0, "lookup").otherwise("insert")
    e = log(spark, sf).select((F.col("doc_id") % CACHES).alias("cache_id"), i.alias("pos"), op.alias("op"), F.col("doc_id").alias("entry"), (i % 15 + 1).alias("k"), F.when(i % 5 == 0, F.floor(i / 400)).alias("seen"))
    return cache.query_cache_inserts(e, CAPACITY).groupBy("cache_id", "outcome").agg(F.count("*").alias("n"), F.count("evicted").alias("evictions"), F.coalesce(F.sum("evicted"), F.lit(0)).alias("evicted"))


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS a FROM v WHERE vec_id % 100 = 0),
c AS (SELECT vec_id AS seq, v AS b FROM v WHERE vec_id % 100 <> 0 ORDER BY vec_id DESC LIMIT {cache.SCANNED}), d AS (SELECT query_id, seq, round({DOT} / sqrt(list_sum(list_transform(a, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))), 12) AS cos FROM q CROSS JOIN c)
SELECT query_id AS doc_id, round(coalesce(arg_min(cos, seq) FILTER (WHERE cos >= 0.3), greatest(0.0, max(cos))), 6) AS likeness FROM d GROUP BY query_id""")
def semantic_likeness(spark, sf):
    """The asked rows against the newest of all others."""
    c = table(spark, sf, "embeddings").where("vec_id % 100 <> 0").select("embedding", F.col("vec_id").alias("seq"))
    out = cache.likeness(asked(spark, sf).withColumnRenamed("query_id", "doc_id"), c, enough=0.3)
    return out.select("doc_id", r6("likeness").alias("likeness"))


@query(f"WITH {CORPUS}, d AS (SELECT query_id, doc_id, round({COS}, 12) AS distance FROM q CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id)::INTEGER AS rank FROM d) SELECT query_id, doc_id, rank FROM r WHERE rank <= {K} AND doc_id IN (SELECT doc_id FROM documents)")
def existing_results(spark, sf):
    """Cached results without those whose document is gone."""
    results = knn.knn(vectors(spark, sf), asked(spark, sf), K).select(F.col("query_id").alias("cache_id"), "doc_id", "rank")
    return cache.existing(results, table(spark, sf, "documents")).withColumnRenamed("cache_id", "query_id")


@query("""SELECT v.vec_id AS doc_id, CASE WHEN label < 3 AND label % 2 = 0 THEN 'cache' WHEN label < 6 AND label <> 4 THEN 'hot' ELSE 'cold' END AS served FROM embeddings v""")
def hydration(spark, sf):
    """A cache with old versions and a hot tier with a damaged vector."""
    e, digest = vectors(spark, sf), V.digest(F.col("embedding"))
    cold = e.select("doc_id", F.lit(1).alias("version"), digest.alias("digest"))
    held = e.where("label < 3").select("doc_id", F.when(F.col("label") % 2 == 1, 0).otherwise(1).alias("version"), digest.alias("digest"), digest.alias("actual"))
    hot = e.where("label < 6").select("doc_id", F.lit(1).alias("version"), digest.alias("digest"), F.when(F.col("label") == 4, 0).otherwise(digest).alias("actual"))
    return merge.hydrated(held, hot, cold)


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'delete' WHEN 'P' THEN 'update' ELSE 'insert' END AS op, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1")
def change_log_read(spark, sf):
    """A change log with damaged lines, read leniently."""
    lines = store.framed(_changes(spark, sf))
    damaged = F.when(F.col("ord") % 11 == 0, F.concat(F.col("line"), F.lit("}"))).otherwise(F.col("line"))
    read = store.unframed(lines.select(damaged.alias("line")), "ord long, seq long, ts long, op string, doc_id long, payload long, metadata string")
    return read.groupBy("op").agg(F.count("*").alias("n"), F.sum("ord").alias("keys"))


@query("SELECT doc_id, place, query_id FROM (SELECT user_id AS doc_id, event_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) WHERE place < 5")
def query_pools(spark, sf):
    return merge.query_pools(log(spark, sf).select("doc_id", F.col("event_id").alias("query_id")), 5).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_BACKUPS} SELECT CAST(id AS VARCHAR) AS id, ts AS timestamp, kind FROM b WHERE id % 13 <> 0")
def backup_list(spark, sf):
    """Of metadata texts some of which are cut."""
    j = F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("ts").alias("timestamp"), "kind"))
    texts = _backups(spark, sf).select(F.when(F.col("id") % 13 == 0, F.substr(j, F.lit(1), F.lit(12))).otherwise(j).alias("value"))
    return ops.listed(texts).select("id", "timestamp", "kind")


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings)
SELECT vec_id, round({L2}, 6) AS apart, round({DOT}, 6) AS product FROM v""")
def vector_distances(spark, sf):
    """Each vector and its reverse."""
    a, b = F.col("embedding"), F.reverse("embedding")
    return table(spark, sf, "embeddings").select("vec_id", r6(V.l2_distance(a, b)).alias("apart"), r6(V.dot(a, b)).alias("product"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 4) / 4 * 32768 AS BIGINT)) AS q FROM embeddings)
SELECT count(*) AS vectors, count(DISTINCT q) AS kinds FROM (SELECT q FROM v UNION ALL SELECT q FROM v)""")
def quantised_kinds(spark, sf):
    """Vectors rounded to quarters, twice each with a difference below the steps that the hash sees."""
    e = F.transform(V.as_double(F.col("embedding")), lambda x: F.round(x * 4) / 4)
    v = table(spark, sf, "embeddings")
    h = v.select(V.quantised_hash(e).alias("h")).unionByName(v.select(V.quantised_hash(F.transform(e, lambda x: x + 1e-6)).alias("h")))
    return h.agg(F.count("*").alias("vectors"), F.count_distinct("h").alias("kinds"))


@query("SELECT doc_id, 3 AS keys, lang FROM documents")
def reserved_metadata(spark, sf):
    """Reserved keys come and go; the caller's own are left."""
    m = V.with_reserved(F.col("metadata"), F.lit("t"), F.lit(3), F.lit("n"))
    return docs(spark, sf).select("doc_id", m.alias("m")).select("doc_id", F.size(V.public_metadata(F.col("m"))).alias("keys"), V.public_metadata(F.col("m"))["lang"].alias("lang"))


@query("""SELECT label % 3 AS tenant, count(*) AS vector_count, sum(len(embedding) * 4)::BIGINT AS storage_bytes, round(sum(len(embedding) * 4) / 1048576.0::DOUBLE, 6) AS storage_mb,
CASE WHEN sum(len(embedding) * 4) >= 1073741824 THEN printf('%.2f GB', sum(len(embedding) * 4) / 1073741824.0::DOUBLE) WHEN sum(len(embedding) * 4) >= 1048576 THEN printf('%.2f MB', sum(len(embedding) * 4) / 1048576.0::DOUBLE)
 WHEN sum(len(embedding) * 4) >= 1024 THEN printf('%.2f KB', sum(len(embedding) * 4) / 1024.0::DOUBLE) ELSE sum(len(embedding) * 4) || ' B' END AS told FROM embeddings GROUP BY 1""")
def usage_storage(spark, sf):
    out = ops.storage(vectors(spark, sf))
    return out.select("tenant", "vector_count", "storage_bytes", r6("storage_mb").alias("storage_mb"), V.format_bytes(F.col("storage_bytes")).alias("told"))


_filter_query("filter_none", Always(), "true")
_filter_query("filter_legacy", from_legacy({"lang": "en", "source": "src2"}, Range("n_chars", "gt", "100")), "lang = 'en' AND source = 'src2' AND n_chars > 100")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(CASE WHEN i = floor(0.5 * (n - 1) + 0.5) THEN value END), 6) AS p50, round(max(CASE WHEN i = floor(0.95 * (n - 1) + 0.5) THEN value END), 6) AS p95 FROM r GROUP BY event_type""")
def percentiles_by_round(spark, sf):
    return hotness.nearest_rank(log(spark, sf), ["event_type"], "value", [50, 95], "round").select("event_type", r6("p50").alias("p50"), r6("p95").alias("p95"))
