"""Usage, quotas, service levels, retention and chains."""

from __future__ import annotations

import os
import tempfile
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hotness import at_places, by_floor

HOUR, DAY = 3600, 86400
#: (class, age below, period of a bucket) in seconds.
CLASSES = (("hourly", DAY, HOUR), ("daily", 7 * DAY, DAY), ("weekly", 28 * DAY, 7 * DAY), ("monthly", 360 * DAY, 30 * DAY))


def usage(events: DataFrame) -> DataFrame:
    """events: tenant, op (query, insert, delete): counts and billable events of each tenant."""
    n = lambda op: F.count_if(F.col("op") == op)
    return events.groupBy("tenant").agg(n("query").alias("query_count"), n("insert").alias("insert_count"), n("delete").alias("delete_count")).withColumn("billable_events", F.col("query_count") + F.col("insert_count") + F.col("delete_count"))


def storage(rows: DataFrame) -> DataFrame:
    """rows: tenant, embedding: how many vectors each tenant has and what they take, at four bytes a component."""
    out = rows.groupBy("tenant").agg(F.count("*").alias("vector_count"), F.sum(4 * F.greatest(F.size("embedding"), F.lit(0)).cast("long")).alias("storage_bytes"))
    return out.withColumn("storage_mb", F.col("storage_bytes") / float(1 << 20))


def saturating(events: DataFrame, by: str, order: str, delta: str) -> DataFrame:
    """A running sum that never falls below 0: the sum less the least of it so far, where that is negative."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = events.withColumn("_s", F.sum(delta).over(w))
    return out.withColumn("value", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w))).drop("_s")


def quota(inserts: DataFrame, most: int) -> DataFrame:
    """inserts: tenant, doc_id, seq: an insert is accepted if its document is among the tenant's first `most`.

    A tenant's documents are dealt to parts, of each of which the first `most` go on, so no task ranks them all.
    """
    first = inserts.groupBy("tenant", "doc_id").agg(F.min("seq").alias("first"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("first", "doc_id"))
    few = first.withColumn("_part", part).withColumn("_at", place("tenant", "_part")).where(F.col("_at") <= most)
    held = few.withColumn("_at", place("tenant")).where(F.col("_at") <= most).select(F.col("tenant").alias("_tenant"), F.col("doc_id").alias("_doc"), F.lit(True).alias("_held"))
    out = inserts.join(held, F.col("tenant").eqNullSafe(F.col("_tenant")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return out.select("tenant", "doc_id", "seq", F.col("_held").isNotNull().alias("accepted"))


def slo(samples: DataFrame, *, p99_ms: float = 10.0, hit_rate: float = 0.70, error_rate: float = 0.001, availability: float = 0.999, least: int = 100) -> DataFrame:
    """samples: service, latency_ms, hit, error: levels of each service, breaches, and its health."""
    out = samples.groupBy("service").agg(F.count("*").alias("total"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(F.col("error").cast("double")).alias("error_rate"))
    p99 = at_places(samples.select(F.col("service").alias("_of"), "latency_ms"), ["_of"], "latency_ms", {"p99": by_floor(99)})
    out = out.join(p99, F.col("service").eqNullSafe(F.col("_of")), "left").drop("_of")
    out = out.withColumn("availability", 1 - F.col("error_rate"))
    broken = F.coalesce(F.col("p99") > p99_ms, F.lit(False)).cast("int") + (F.col("hit_rate") < hit_rate).cast("int") + (F.col("error_rate") > error_rate).cast("int") + (F.col("availability") < availability).cast("int")
    out = out.withColumn("breaches", F.when(F.col("total") >= least, broken).otherwise(0))
    return out.withColumn("health", health(F.col("breaches"), F.lit(False), F.lit(0)))


def error_class(message: Column) -> Column:
    """The kind of a failed search, by words of its message; the first kind that fits counts."""
    m = F.translate(message, ascii_uppercase, ascii_lowercase)
    has = lambda *words: reduce(Column.__or__, [m.contains(w) for w in words])
    out = F.when(has("timed out", "timeout"), "timeout").when(has("saturated", "resource exhausted", "max in-flight"), "resource_exhausted")
    return out.when(has("invalid", "dimension mismatch", "cannot be empty", "must be"), "validation").otherwise("internal")


def health(breaches: Column, log_inconsistent: Column, log_failures: Column) -> Column:
    """A service's health from its breaches; an inconsistent change log overrides it, failed writes lower the best."""
    base = F.when(breaches == 0, "healthy").when(breaches == 1, "degraded").otherwise("unhealthy")
    return F.when(log_inconsistent, "unhealthy").when((log_failures > 0) & (breaches == 0), "degraded").otherwise(base)


def tier_stats(served: DataFrame) -> DataFrame:
    """served: tier (cache, query_cache, hot, cold): hits of each tier and their shares of all queries, in one row."""
    n = lambda *tiers: F.count_if(F.col("tier").isin(*tiers))
    out = served.agg(F.count("*").alias("total_queries"), n("cache").alias("cache_hits"), n("query_cache").alias("query_cache_hits"), n("hot").alias("hot_hits"), n("cold").alias("cold_searches"))
    share = lambda *cols: F.coalesce(F.try_divide(reduce(Column.__add__, [F.col(c) for c in cols]), F.col("total_queries")), F.lit(0.0))
    return out.withColumns({"cache_hit_rate": share("cache_hits"), "query_cache_hit_rate": share("query_cache_hits"), "l1_hit_rate": share("cache_hits", "query_cache_hits"), "overall_hit_rate": share("cache_hits", "query_cache_hits", "hot_hits")})


def metrics_text(samples: DataFrame, name: str, kind: str, description: str, label: str, value: str) -> DataFrame:
    """(ord, line): a metric in the text format of Prometheus: its two heads, then a line for each row."""
    head = samples.sparkSession.createDataFrame([(0, f"# HELP {name} {description}"), (1, f"# TYPE {name} {kind}")], "ord int, line string")
    safe = F.replace(F.replace(F.replace(F.col(label).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    rows = samples.select(F.lit(2).alias("ord"), F.concat(F.lit(f'{name}{{{label}="'), safe, F.lit('"} '), F.col(value).cast("string")).alias("line"))
    return head.unionByName(rows)


def api_key(key: Column, prefix: str) -> tuple[Column, Column, Column]:
    """(tenant, redacted, problem) of a key `<prefix><tenant>_<secret>`; tenant is null and problem says why if it isn't valid."""
    tenant = F.regexp_extract(key, "(?s)^(.*)_[^_]*$", 1)
    inner = F.when(F.length(tenant) > len(prefix), F.substr(tenant, F.lit(len(prefix) + 1))).otherwise("")
    secret = F.substring_index(key, "_", -1)
    problem = F.when(~key.startswith(prefix), "prefix").when(F.octet_length(key) < len(prefix) + 34, "too short").when(inner == "", "format")
    problem = problem.when(~inner.rlike("^[A-Za-z0-9_]+$"), "tenant").when(F.octet_length(secret) < 32, "secret too short").when(~secret.rlike("^[A-Za-z0-9]+$"), "secret")
    redacted = F.when(key.contains("_"), F.concat(tenant, F.lit("_<redacted>"))).otherwise("<redacted>")
    return F.when(problem.isNull(), inner), redacted, problem


def retention(backups: DataFrame, now: int, *, least_age: int = 0) -> DataFrame:
    """backups: id, ts (seconds): class and bucket of each, and whether it stays: the newest of a bucket, and those too young to go."""
    age = F.lit(now) - F.col("ts")
    cls, bucket = F.lit("expired"), F.lit(-1).cast("long")
    for name, below, period in reversed(CLASSES):
        cls = F.when(age < below, name).otherwise(cls)
        bucket = F.when(age < below, F.floor(F.col("ts") / period)).otherwise(bucket)
    out = backups.withColumn("class", cls).withColumn("bucket", bucket)
    # unexpired buckets are as few as the classes have periods, so the newest of each are broadcast; expired backups are in none
    newest = out.where("class <> 'expired'").groupBy(F.col("class").alias("_class"), F.col("bucket").alias("_bucket")).agg(F.max(F.struct("ts", "id")).alias("_newest"))
    out = out.join(F.broadcast(newest), (F.col("class") == F.col("_class")) & (F.col("bucket") == F.col("_bucket")), "left")
    return out.withColumn("keep", F.coalesce(F.struct("ts", "id") == F.col("_newest"), F.lit(False)) | (age < least_age)).drop("_class", "_bucket", "_newest")


def chain(backups: DataFrame, until: int) -> DataFrame:
    """backups: id, parent_id, ts, kind: the newest full backup at or before a time and the increments that follow it, with their step.

    Each round doubles how far every backup has looked back, so a chain of n steps takes log2(n) rounds of one join, each
    cut off by checkpoint(). Backups whose parents form a ring belong to no chain.
    """
    spark, rows = backups.sparkSession, backups.select("id", "parent_id", "ts", "kind").where(F.col("ts") <= int(until))
    full = rows.where("kind = 'full'").orderBy(F.col("ts").desc(), F.col("id").desc()).select("id").first()
    if full is None:
        return rows.limit(0).withColumn("step", F.lit(0))
    _checkpoints(spark)
    root = F.lit(full.id)
    parent = rows.select(F.col("id").alias("_parent"))
    # a backup's oldest known forebear and the steps to it; one without a parent is its own
    at = rows.join(parent, F.col("parent_id") == F.col("_parent"), "left")
    at = at.select("id", F.when((F.col("id") == root) | F.col("_parent").isNull(), F.col("id")).otherwise(F.col("_parent")).alias("at")).withColumn("step", (F.col("id") != F.col("at")).cast("int")).checkpoint()
    for _ in range(max(1, at.count()).bit_length()):
        up = at.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("step").alias("_step"))
        further = at.join(up, F.col("at") == F.col("_id")).select("id", F.col("_at").alias("at"), (F.col("step") + F.col("_step")).alias("step"), (F.col("at") != F.col("_at")).alias("moved")).checkpoint()
        at = further.select("id", "at", "step")
        if further.where("moved").isEmpty():
            break
    return rows.join(at.where(F.col("at") == root).select("id", "step"), "id").select("id", "parent_id", "ts", "kind", "step")


def _checkpoints(spark) -> None:
    """The folder for checkpoint(): what the session names, and one of its own only on a single machine that names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "orrery-checkpoints"))


def listed(texts: DataFrame) -> DataFrame:
    """texts: value (a backup's metadata as JSON): the backups, newest first; what can't be read is left out."""
    b = F.from_json("value", "id string, timestamp long, kind string, parent_id string, size_bytes long").alias("b")
    return texts.select(b).where("b.id IS NOT NULL AND b.timestamp IS NOT NULL").select("b.*").orderBy(F.col("timestamp").desc(), "id")
