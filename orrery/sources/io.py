"""Files: A/B metrics, usage, vectors, snapshots with a manifest."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ops import listed
from ..operators.store import framed, unframed

AB_SCHEMA = "timestamp_ms long, strategy string, event_type string, doc_id long, latency_ns long"


def read_ab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AB_SCHEMA).csv(path, header=False)


def write_ab(metrics: DataFrame, path: str, mode: str = "append") -> None:
    metrics.select("timestamp_ms", "strategy", "event_type", "doc_id", "latency_ns").write.mode(mode).csv(path, header=False)


def write_usage(usage: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; storage_mb of two decimals."""
    usage.withColumn("storage_mb", F.format_string("%.2f", F.col("storage_bytes") / (1 << 20))).write.mode(mode).csv(path, header=True)


USAGE_SCHEMA = "tenant string, query_count long, insert_count long, delete_count long, vector_count long, storage_bytes long"


def save_usage(usage: DataFrame, path: str) -> None:
    """Usage as lines of JSON, to go on from after a restart."""
    columns = [c.split()[0] for c in USAGE_SCHEMA.split(", ")]
    usage.select(*columns).write.mode("overwrite").json(path)


def restored_usage(spark: SparkSession, path: str) -> DataFrame:
    """Saved usage; none where nothing is saved."""
    p, fs = _fs(spark, path)
    return spark.read.schema(USAGE_SCHEMA).json(path) if fs.exists(p) else spark.createDataFrame([], USAGE_SCHEMA)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, embedding) of .npy files of two dimensions; each file's own header tells its shape."""

    def f(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    off = pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.ListArray.from_arrays(off, pa.array(part.ravel()))], ["path", "row", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(f, "path string, row long, embedding array<float>")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_snapshot(docs: DataFrame, root: str, seq: int) -> str:
    """Writes a version of its own, and only then its manifest, so a reader never sees half a snapshot."""
    spark, path = docs.sparkSession, f"{root}/snapshot-{seq:020d}"
    docs.withColumn("_crc", F.crc32(F.to_json(F.struct(*docs.columns)))).write.mode("overwrite").parquet(path)
    spark.createDataFrame([(json.dumps({"seq": seq, "path": path}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return path


def load_snapshot(spark: SparkSession, root: str, *, tries: int = 5, strict: bool = True) -> tuple[DataFrame, int]:
    """The newest whole snapshot; an unreadable one gives way to an older one. strict: a bad row is an error, else it is left out."""
    p, fs = _fs(spark, root)
    names = sorted((s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".manifest")), reverse=True)
    last: Exception | None = None
    for name in names[:tries]:
        try:
            manifest = json.loads(spark.read.text(f"{root}/{name}").first()[0])
            rows = spark.read.parquet(manifest["path"])
            good = F.col("_crc") == F.crc32(F.to_json(F.struct(*[c for c in rows.columns if c != "_crc"])))
            if strict and not rows.where(~good).isEmpty():
                raise ValueError(f"{manifest['path']} has rows that don't match their checksum")
            return rows.where(good).drop("_crc"), manifest["seq"]
        except Exception as e:  # noqa: BLE001  any damage: try the one before
            last = e
    raise FileNotFoundError(f"no readable snapshot in {root}") from last


LOG_SCHEMA = "ord long, seq long, ts long, op string, doc_id long, payload long, metadata string"


def write_log(entries: DataFrame, path: str, mode: str = "append") -> None:
    """A change log as text, a checksum before each entry."""
    framed(entries).select(F.col("line").alias("value")).write.mode(mode).text(path)


def read_log(spark: SparkSession, path: str, *, schema: str = LOG_SCHEMA, strict: bool = False) -> DataFrame:
    """The entries of a change log in any order; damaged ones are left out, or with strict end the job."""
    return unframed(spark.read.text(path).withColumnRenamed("value", "line"), schema, strict=strict)


def list_backups(spark: SparkSession, folder: str) -> DataFrame:
    """The backups whose metadata files (.json) lie in a folder, newest first; files that can't be read are left out."""
    return listed(spark.read.text(f"{folder}/*.json", wholetext=True))
