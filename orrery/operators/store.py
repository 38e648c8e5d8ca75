"""The document store as tables: latest state, deletes, metadata updates, replay and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import is_finite, merged_metadata
from .filters import compiled

MOST_DIMENSIONS = 4096


def problem(id_: Column, embedding: Column, dimension: int | None = None) -> Column:
    """Why a row can't be inserted; null if it can."""
    size = F.size(embedding)
    out = F.when(id_.isNull() | (id_ < 1), "doc_id must be at least 1").when(embedding.isNull() | (size < 1), "embedding is empty").when(size > MOST_DIMENSIONS, "embedding is too long").when(~is_finite(embedding), "embedding is not finite")
    return out if dimension is None else out.when(size != dimension, "embedding has another dimension")


def latest(changes: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """Each key's row of the largest order, deletes left out; versions count from the last delete. Aggregates only: no key's history is sorted."""
    others = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_last"), F.count("*").alias("_all")).where("_last.op <> 'delete'")
    # all versions count where no delete came; keys with one are looked at again, at two columns
    gone = changes.where("op = 'delete'").groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_gone"))
    after = changes.select(key, order).join(gone, F.col(key).eqNullSafe(F.col("_key"))).where(F.col(order) > F.col("_gone")).groupBy("_key").agg(F.count("*").alias("_after"))
    out = last.join(after, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, *(F.col(f"_last.{c}").alias(c) for c in others), F.coalesce("_after", "_all").alias("version"))


def lookup(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, doc_id) with the document or nulls: one row for each asked, repeats and misses too."""
    d = docs.withColumnRenamed("doc_id", "_id")
    return ids.join(d, F.col("doc_id") == F.col("_id"), "left").withColumn("found", F.col("_id").isNotNull()).drop("_id")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def without_matching(docs: DataFrame, where) -> DataFrame:
    return docs.where(~compiled(where, F.col("metadata")))


def updated(docs: DataFrame, updates: DataFrame, merge: bool) -> DataFrame:
    """updates: doc_id, new (a map). Rows without an update stay; updates of absent rows have no effect."""
    new = merged_metadata(F.col("metadata"), F.col("new")) if merge else F.col("new")
    return docs.join(updates, "doc_id", "left").withColumn("metadata", F.when(F.col("new").isNull(), F.col("metadata")).otherwise(new)).drop("new")


def replayed(snapshot: DataFrame, log: DataFrame, last_seq: int, snapshot_ts: int) -> DataFrame:
    """State after a snapshot and a log.

    snapshot: doc_id, payload, metadata; log: ord, seq, ts, op (insert, delete, update), doc_id, payload, metadata. Entries
    that the snapshot holds (by seq, or by ts where seq is 0) are skipped; an update replaces the metadata of a
    document that is there.
    """
    live = log.where(((F.col("seq") > 0) & (F.col("seq") > last_seq)) | ((F.col("seq") == 0) & (F.col("ts") > snapshot_ts)))
    cols = ["doc_id", "ord", "op", "payload", "metadata"]
    every = snapshot.select("doc_id", F.lit(-1).cast("long").alias("ord"), F.lit("insert").alias("op"), "payload", "metadata").unionByName(live.select(*cols))
    is_base = F.col("op").isin("insert", "delete")
    base = F.max_by(F.struct("op", "payload", "metadata", "ord"), F.when(is_base, F.col("ord")))
    last_base = F.max(F.when(is_base, F.col("ord")))
    update = F.max_by(F.struct("metadata", "ord"), F.when(F.col("op") == "update", F.col("ord")))
    got = every.groupBy("doc_id").agg(base.alias("b"), last_base.alias("at"), update.alias("u")).where("b.op = 'insert'")
    return got.select("doc_id", F.col("b.payload").alias("payload"), F.when(F.col("u.ord") > F.col("at"), F.col("u.metadata")).otherwise(F.col("b.metadata")).alias("metadata"))


def coherence(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Whether each mirrored row is the canonical one. Both: doc_id, version, digest; hot also actual, its own digest now."""
    c = cold.select(F.col("doc_id").alias("_id"), F.col("version").alias("_v"), F.col("digest").alias("_d"))
    status = F.when(F.col("_id").isNull(), "missing").when(F.col("actual") != F.col("digest"), "corrupt").when((F.col("version") != F.col("_v")) | (F.col("digest") != F.col("_d")), "stale").otherwise("match")
    return hot.join(c, F.col("doc_id") == F.col("_id"), "left").select("doc_id", status.alias("status"))


def snapshot_problems(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Counts: duplicate ids, dimensions, documents without metadata and metadata without documents."""
    a = docs.agg((F.count("doc_id") - F.countDistinct("doc_id")).alias("duplicates"), F.countDistinct(F.size("embedding")).alias("dimensions"))
    b = docs.select(F.col("doc_id").alias("d")).join(metadata.select(F.col("doc_id").alias("m")), F.col("d") == F.col("m"), "full_outer")
    b = b.agg(F.count_if(F.col("m").isNull()).alias("without_metadata"), F.count_if(F.col("d").isNull()).alias("without_document"))
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def kept_segments(segments: DataFrame, snapshot_seq: int) -> DataFrame:
    """Log segments that recovery still needs."""
    return segments.where(F.col("max_seq") > snapshot_seq)


def load_report(rows: DataFrame, dimension: int | None = None) -> DataFrame:
    """rows: doc_id, embedding: how many rows of a bulk load are accepted, and how many fail for each reason."""
    return rows.select(F.coalesce(problem(F.col("doc_id"), F.col("embedding"), dimension), F.lit("accepted")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def framed(entries: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, line): each entry of a change log as its CRC-32 and JSON, so that damage shows."""
    body = F.to_json(F.struct(*entries.columns))
    return entries.select(F.col(order).alias("ord"), F.concat(F.lpad(F.lower(F.hex(F.crc32(body))), 8, "0"), F.lit(" "), body).alias("line"))


def unframed(lines: DataFrame, schema: str, *, strict: bool = False) -> DataFrame:
    """lines: line: the entries of a framed log. A damaged line is left out, or with strict ends the job."""
    body = F.substr("line", F.lit(10))
    good = F.coalesce((F.length("line") > 9) & (F.substring("line", 9, 1) == " ") & (F.substring("line", 1, 8) == F.lpad(F.lower(F.hex(F.crc32(body))), 8, "0")), F.lit(False))
    entry = F.from_json(body, schema)
    if strict:
        return lines.select(F.when(good, entry).otherwise(F.raise_error(F.lit("a damaged entry in the change log")).cast(entry_type(schema))).alias("e")).select("e.*")
    return lines.where(good).select(entry.alias("e")).select("e.*")


def entry_type(schema: str) -> str:
    return f"struct<{', '.join(':'.join(c.split()) for c in schema.split(', '))}>"
