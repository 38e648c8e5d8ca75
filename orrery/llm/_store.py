"""Shared files: folders under spark.checkpoint.dir, and arrays that workers write once and memory-map.

An array file is written under a name of its own attempt and then renamed, so a repeated or speculative
task leaves the same file. A store other than a mounted file system is reached through pyarrow.fs; its
arrays are fetched to the worker's temporary folder and deleted there once mapped.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder only where it is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "orrery-checkpoints")
    return base.rstrip("/")


_MADE: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's address; nothing is there yet."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def owned(spark: SparkSession):
    """Deletes at its end the folders that operators made inside it: for callers that have stored the results by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            drop(spark, path)
        del _MADE[before:]


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Frames made and run inside leave no shuffle files: their results lie in the shared folder, and nothing reads the files again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends here."""
    spark = df.sparkSession
    with tidy(spark):
        df.select("*").write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _local(uri: str) -> str | None:
    """The path of a mounted file, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put(uri: str, array: np.ndarray) -> None:
    """Write an array as .npy. Safe to repeat."""
    _write(uri, lambda f: np.save(f, array))


def put_all(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays into one file: the head's length, the head (dtype, shape and place of each array), the arrays. Safe to repeat."""
    arrays = {name: np.ascontiguousarray(a) for name, a in arrays.items()}
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, a.shape, at]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(8 + len(text)) % 64)

    def save(f):
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + bytes(-a.nbytes % 64))

    _write(uri, save)


def _write(uri: str, save) -> None:
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            save(f)
        os.replace(tmp, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(tmp) as f:
        save(f)
    store.move(tmp, path)


_OPEN: dict = {}
#: Files that a worker keeps open. Each is one mapping, of which Linux grants a process 65,530.
MOST_OPEN = 32768


def get(uri: str, absent: np.ndarray | None = None) -> np.ndarray:
    """The array, memory-mapped; each worker process opens a file once. absent: what stands for a file that isn't there."""
    if uri in _OPEN:
        return _OPEN[uri]
    if absent is not None:
        try:
            return get(uri)
        except FileNotFoundError:
            return absent
    return _opened(uri, _mapped)


def get_all(uri: str) -> dict[str, np.ndarray]:
    """The arrays of put_all's file, memory-mapped as one; each worker process opens a file once."""
    return _OPEN[uri] if uri in _OPEN else _opened(uri, _mapped_all)


def _opened(uri: str, mapped):
    while len(_OPEN) >= MOST_OPEN:  # the one opened first goes
        _OPEN.pop(next(iter(_OPEN)))
    if path := _local(uri):
        array = mapped(path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        fd, tmp = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as out, store.open_input_stream(path) as f:
                while block := f.read(1 << 20):
                    out.write(block)
            array = mapped(tmp)
        finally:
            os.unlink(tmp)  # the mapping keeps the pages
    _OPEN[uri] = array
    return array


def _mapped(path: str) -> np.ndarray:
    if os.path.getsize(path) <= 4096:
        return np.load(path)
    return np.load(path, mmap_mode="r")


def _mapped_all(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        data = f.read() if os.path.getsize(path) <= 4096 else mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    start = 8 + int.from_bytes(data[:8], "little")
    return {name: np.frombuffer(data, kind, math.prod(shape), start + at).reshape(shape) for name, (kind, shape, at) in json.loads(data[8:start]).items()}


def find(keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """Where each probe stands in the sorted keys, -1 where it is absent. The probes go in rising order, so pages are read once."""
    if not len(keys) or not len(probe):
        return np.full(len(probe), -1, np.int64)
    order = np.argsort(probe)
    p = probe[order]
    at = np.searchsorted(keys, p)
    at[at == len(keys)] = len(keys) - 1
    hit = np.where(keys[at] == p, at, -1)
    out = np.empty(len(probe), np.int64)
    out[order] = hit
    return out


class Store:
    """Arrays by shard, written by tasks and mapped by workers. sizes: rows of each shard that has any."""

    def __init__(self, uri: str, sizes: dict[int, int]):
        self.uri, self.sizes = uri, sizes

    def array(self, shard: int, name: str) -> np.ndarray:
        return get(f"{self.uri}/{shard}-{name}.npy")

    def arrays(self, shard: int) -> dict[str, np.ndarray]:
        """All of a shard that was built with `together`."""
        return get_all(f"{self.uri}/{shard}.arrays")

    @property
    def rows(self) -> int:
        return sum(self.sizes.values())


def build(df: DataFrame, shards: int, arrays, uri: str, extra: str = "", together: bool = False) -> tuple[Store, list]:
    """Write one set of arrays for each value of df's column `shard`.

    arrays(shard, table) gets a shard's rows as a pyarrow table and returns its arrays by name, of which
    `key` gives its size; `stats`, if there, is a short dict of numbers that goes to the driver. A shard
    must fit a task: the caller deals by a hash, and more shards for more rows. together: a shard's arrays are one file.
    """

    def write(batches):  # of one shard, as the shard's number is the task's
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        ids = table.column("shard")
        for shard in pc.unique(ids).to_pylist():
            out = arrays(shard, table.filter(pc.equal(ids, shard)).combine_chunks())
            stats = out.pop("stats", {})
            if together:
                put_all(f"{uri}/{shard}.arrays", out)
            for name, a in () if together else out.items():
                put(f"{uri}/{shard}-{name}.npy", a)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(out["key"])], pa.int64()), "stats": [json.dumps(stats)]})

    with tidy(df.sparkSession):
        rows = df.repartitionById(shards, "shard").mapInArrow(write, "shard int, n long, stats string").collect()
    return Store(uri, {r.shard: r.n for r in rows}), [json.loads(r.stats) for r in rows]


#: Rows that carry numbers between tasks by the thousand: each holds what one batch has for one shard.
BLOCKS = "shard int, n int, block binary"


def blocks(shard: np.ndarray, *cols: np.ndarray, rising: bool = False):
    """Record batches with one row for each shard: its values of all columns, one column after the other.

    rising: the first column rises within each shard and goes as differences, and all go byte by byte, the lowest bytes first: the
    high ones of small numbers are alike, so Spark's compression leaves little of them.
    """
    import pyarrow as pa

    order = np.argsort(shard, kind="stable")
    ids, starts = np.unique(shard[order], return_index=True)
    ends = np.append(starts, len(order))[1:]
    cols = [c[order] for c in cols]
    data = []
    for a, b in zip(starts, ends, strict=True):
        parts = [c[a:b] for c in cols]
        if rising:
            parts[0] = np.diff(parts[0], prepend=parts[0].dtype.type(0))
            parts = [np.ascontiguousarray(p).view(np.uint8).reshape(b - a, -1).T for p in parts]
        data.append(b"".join(p.tobytes() for p in parts))
    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(data, pa.binary())], ["shard", "n", "block"])


def unblock(t, *types, rising: bool = False) -> tuple[np.ndarray, ...]:
    """The columns that a shard's blocks hold."""
    parts: list[list] = [[] for _ in types]
    for n, block in zip(t.column("n").to_pylist(), t.column("block").to_pylist(), strict=True):
        at = 0
        for i, (part, kind) in enumerate(zip(parts, types, strict=True)):
            size = np.dtype(kind).itemsize
            if rising:
                col = np.ascontiguousarray(np.frombuffer(block, np.uint8, n * size, at).reshape(size, n).T).view(kind)[:, 0]
                part.append(col if i else np.cumsum(col, dtype=kind))
            else:
                part.append(np.frombuffer(block, kind, n, at))
            at += n * size
    return tuple(np.concatenate([np.zeros(0, k), *p]).astype(k, copy=False) for p, k in zip(parts, types, strict=True))
