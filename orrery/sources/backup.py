"""Backups of a document table in a folder of any store that Spark writes to: full ones and the changes since another.

A backup is Parquet with a checksum of each row, written under a name of its own; then its metadata, a small JSON
file, is written, so a broken-off backup is never listed. A restore reads the newest full backup at or before the asked one and the
changes between, as one table of changes, and takes their latest state.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import latest
from .io import list_backups

CHECK = "_crc"


def _sum(df: DataFrame) -> Column:
    return F.crc32(F.to_json(F.struct(*(c for c in df.columns if c != CHECK))))


def _write(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def save(changes: DataFrame, folder: str, id_: str, *, parent: str | None = None, at: int | None = None) -> None:
    """changes: doc_id, seq, op (insert, update, delete), other columns: all of them, or with a parent those after its last seq."""
    spark = changes.sparkSession
    since = metadata(spark, folder, parent)["last_seq"] if parent is not None else None
    rows = changes if since is None else changes.where(F.col("seq") > since)
    path = f"{folder}/{id_}.data"
    rows.withColumn(CHECK, _sum(rows)).write.mode("errorifexists").parquet(path)
    written = spark.read.parquet(path).agg(F.count("*").alias("n"), F.max("seq").alias("last")).first()
    kind = "full" if parent is None else "incremental"
    last = written.last if written.last is not None else since if since is not None else -1
    _write(spark, f"{folder}/{id_}.json", json.dumps({"id": id_, "timestamp": int(time.time()) if at is None else at, "kind": kind, "parent_id": parent, "rows": written.n, "last_seq": last}))


def metadata(spark: SparkSession, folder: str, id_: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/{id_}.json", wholetext=True).first()[0])


def verify(spark: SparkSession, folder: str, id_: str) -> bool:
    """Whether a backup has as many rows as its metadata tells, and all of them whole."""
    rows = spark.read.parquet(f"{folder}/{id_}.data")
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col(CHECK) == _sum(rows)).alias("whole")).first()
    return n.n == n.whole == metadata(spark, folder, id_)["rows"]


def restore(spark: SparkSession, folder: str, *, until: int | None = None) -> DataFrame:
    """The state as of the newest backup (at or before `until`): each document's last change, deletes left out, without a version.

    A damaged row of a backup that is needed ends the job.
    """
    listed = list_backups(spark, folder).select("id", "timestamp", "kind", "parent_id")
    every = {r.id: r for r in listed.collect() if until is None or r.timestamp <= until}  # a row for each backup
    if not every:
        raise FileNotFoundError(f"no backup in {folder}")
    at = max(every.values(), key=lambda r: (r.timestamp, r.id))
    chain = [at]
    while chain[-1].kind != "full":
        if chain[-1].parent_id not in every or len(chain) > len(every):
            raise FileNotFoundError(f"the parent of {chain[-1].id} is not in {folder}")
        chain.append(every[chain[-1].parent_id])
    rows = spark.read.parquet(*(f"{folder}/{r.id}.data" for r in chain))
    damaged = F.raise_error(F.lit("a damaged row in a backup")).cast("long")
    rows = rows.withColumn(CHECK, F.when(F.col(CHECK) == _sum(rows), F.col(CHECK)).otherwise(damaged)).where(F.col(CHECK).isNotNull()).drop(CHECK)
    return latest(rows).drop("version", "op")
