"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is `width` consecutive words of an item (a shorter item is one window). Its shingles are the
runs of up to `run` words in it. A document that holds the window holds all its shingles, so the one
that is rarest over all documents is a sufficient prefix. Documents are probed for these prefixes only;
the shingle's place gives the window's place (positional bound), which must lie inside the document
(length bound), and all its words are then compared.

No document is shuffled: the index is written to shared files and memory-mapped by the workers, so
neither a passage in a third of all documents nor a long document makes an uneven task.

Nulls and edges: a null text has no words; an item with a null id or without words takes no part; equal
items are all listed; a window that many items share lists them all, once, in the index, and a document's list is as long as
its result asks for: both are bounded by the number of items, not by the documents; repeated rows are judged each alone; an empty
table of either kind gives no hits. Incoming columns named like a result are dropped.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store as S
from . import _text as X

WINDOWS_PER_SHARD = 1_000_000
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """At each word the hash of the k words from there; the last k - 1 places mean nothing."""
    out = h.copy()
    for i in range(1, k):
        out[: len(h) - i] = X.mix(out[: len(h) - i] * X.GOLD + h[i:])
    return out


def _item_windows(width: int):
    def f(batches):
        for b in X.pieces(batches):
            h, off = X.words(b.column("text"), X.ALNUM)
            ids = b.column("item_id").to_pylist()
            rows: dict[str, list] = {"window": [], "words": [], "item_id": []}
            for d, item in enumerate(ids):
                w = h[off[d] : off[d + 1]]
                if item is None or not len(w):
                    continue
                n = min(width, len(w))
                for i in range(len(w) - n + 1):
                    raw = w[i : i + n].tobytes()
                    rows["words"].append(raw)
                    rows["window"].append(hashlib.sha256(raw).digest()[:16])
                    rows["item_id"].append(item)
            yield pa.RecordBatch.from_pydict({"window": pa.array(rows["window"], pa.binary()), "words": pa.array(rows["words"], pa.binary()), "item_id": pa.array(rows["item_id"], pa.string())})

    return f


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h % X.U(shards)).astype(np.int32)


def _shingle_rows(run: int, shards: int):
    def f(batches):
        for b in batches:
            found = set()
            for raw in b.column("words").to_pylist():
                w = np.frombuffer(raw, X.U)
                k = min(run, len(w))
                found.update((k, s) for s in runs(w, k)[: len(w) - k + 1].tolist())
            key = np.array([s for _, s in found], X.U)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(_shard(key, shards)), "k": pa.array([k for k, _ in found], pa.int32()), "key": pa.array(key.view(np.int64))})

    return f


_SIEVES: dict[tuple, np.ndarray] = {}


def _probe(store: S.Store, shards: int, k: int, r: np.ndarray) -> np.ndarray:
    """The places of r that are keys of length k, by a bitmap of the keys' low bits and then exactly."""
    id_ = (store.uri, k)
    if id_ not in _SIEVES:
        sieve = np.zeros(1 << 22, bool)
        for s in store.sizes:
            keys = store.array(s, "key")
            sieve[(keys[store.array(s, "k") == k].view(X.U) & X.U((1 << 22) - 1)).astype(np.int64)] = True
        while len(_SIEVES) >= 8:  # of 4 MB each, in a worker that is used again
            _SIEVES.pop(next(iter(_SIEVES)))
        _SIEVES[id_] = sieve
    maybe = np.flatnonzero(_SIEVES[id_][(r & X.U((1 << 22) - 1)).astype(np.int64)])
    ok = np.zeros(len(maybe), bool)
    of = _shard(r[maybe], shards)
    for s in store.sizes.keys() & set(of.tolist()):
        mine = np.flatnonzero(of == s)
        ok[mine] = S.find(store.array(s, "key"), r[maybe[mine]].view(np.int64)) >= 0
    return maybe[ok]


def _keys(shard, t):
    key, k = t.column("key").to_numpy(), t.column("k").to_numpy()
    order = np.argsort(key, kind="stable")
    key, k = key[order], k[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])  # one length for a key: equal hashes of two lengths are not met
    return {"key": key[first], "k": k[first], "stats": {"k": sorted({int(x) for x in k})}}


def _counts(store: S.Store, shards: int, ks: list[int]):
    def f(batches):
        for b in X.pieces(batches):
            h, off = X.words(b.column("text"), X.ALNUM)
            found = []
            for k in ks:
                r = runs(h, k)
                at = _probe(store, shards, k, r)
                doc = np.searchsorted(off, at, "right") - 1
                found.append(r[at[at + k <= off[doc + 1]]])
            key, n = X.sum_runs(np.concatenate([np.zeros(0, X.U), *found]), np.ones(sum(map(len, found)), np.int64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(n)})

    return f


def _anchors(freq: S.Store, shards: int, run: int):
    """Each window with its rarest shingle; a window with a shingle that no document has can't occur."""

    def f(batches):
        for b in batches:
            rows: dict[str, list] = {"shard": [], "k": [], "key": [], "at": []}
            keep = []
            for i, raw in enumerate(b.column("words").to_pylist()):
                w = np.frombuffer(raw, X.U)
                k = min(run, len(w))
                s = runs(w, k)[: len(w) - k + 1]
                n, of = np.zeros(len(s), np.int64), _shard(s, shards)
                for x in set(of.tolist()) & freq.sizes.keys():
                    at = S.find(freq.array(x, "key"), s[of == x].view(np.int64))
                    n[of == x] = np.where(at < 0, 0, freq.array(x, "n")[at])
                if n.min() == 0:
                    continue
                best = int(np.lexsort((np.arange(len(s)), s, n))[0])
                keep.append(i)
                for name, v in (("shard", of[best]), ("k", k), ("key", s[best : best + 1].view(np.int64)[0]), ("at", best)):
                    rows[name].append(int(v))
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), pa.array(rows["k"], pa.int32()), pa.array(rows["key"], pa.int64()), pa.array(rows["at"], pa.int32()), out.column("words"), out.column("items")], ["shard", "k", "key", "at", "words", "items"])

    return f


def _index(shard, t):
    order = np.argsort(t.column("key").to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    words, items = t.column("words").to_pylist(), [x.encode() for x in t.column("items").to_pylist()]
    ends = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    return {"key": t.column("key").to_numpy(), "k": t.column("k").to_numpy(), "at": t.column("at").to_numpy().astype(np.int64), "words": np.frombuffer(b"".join(words), X.U), "words_off": ends(words) // 8, "items": np.frombuffer(b"".join(items), np.uint8), "items_off": ends(items)}


def _occurrences(index: S.Store, shards: int, ks: list[int], h: np.ndarray, off: np.ndarray):
    """Verified windows: (start word, length, shard, entry) of all."""
    for k in ks:
        r = runs(h, k)
        at = _probe(index, shards, k, r)
        of = _shard(r[at], shards)
        for s in sorted(index.sizes.keys() & set(of.tolist())):
            pos = at[of == s]
            keys = index.array(s, "key")
            lo, hi = (np.searchsorted(keys, r[pos].view(np.int64), side) for side in ("left", "right"))
            words, w_off, place = index.array(s, "words"), index.array(s, "words_off"), index.array(s, "at")
            step = 0
            while step < len(pos):  # blocks of at most about 100,000 candidates
                n = np.cumsum(hi[step:] - lo[step:])
                to = step + max(1, int(np.searchsorted(n, 100_000)))
                a, b = lo[step:to], hi[step:to]
                entry = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
                start = np.repeat(pos[step:to], b - a) - place[entry]
                doc = np.searchsorted(off, np.repeat(pos[step:to], b - a), "right") - 1
                length = w_off[entry + 1] - w_off[entry]
                ok = (start >= off[doc]) & (start + length <= off[doc + 1])
                start, entry, length = start[ok], entry[ok], length[ok]
                for n in np.unique(length):
                    m = np.flatnonzero(length == n)
                    same = np.ones(len(m), bool)
                    for i in range(n):
                        same &= h[start[m] + i] == words[w_off[entry[m]] + i]
                    m = m[same]
                    yield start[m], int(n), s, entry[m]
                step = to


def _judge(index: S.Store, shards: int, ks: list[int], share: int, keep: list[str]):
    def f(batches):
        for b in X.pieces(batches):
            h, off = X.words(b.column("text"), X.ALNUM)
            edge = np.zeros(len(h) + 1, np.int64)
            found: list[set] = [set() for _ in range(b.num_rows)]
            for start, n, s, entry in _occurrences(index, shards, ks, h, off):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n, -1)
                doc = np.searchsorted(off, start, "right") - 1
                for d, e in set(zip(doc.tolist(), entry.tolist(), strict=True)):
                    found[d].add((s, e))
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
            n_words, n_hit = np.diff(off), hit[off[1:]] - hit[off[:-1]]
            items = []
            for x in found:
                names = set()
                for s, e in x:
                    o = index.array(s, "items_off")
                    names.update(json.loads(index.array(s, "items")[o[e] : o[e + 1]].tobytes()))
                items.append(sorted(names))
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(digest), pa.array((n_hit > 0) & (share * n_hit >= n_words))], [*keep, *RESULT.names])

    return f


def contamination(docs: DataFrame, items: DataFrame, *, width: int = 13, run: int = 5, share: int = 20) -> DataFrame:
    """docs(text, ...) with n_words, n_hit (words inside an occurrence of a window), items, items_sha256, contaminated.

    items: item_id, text. contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    spark = docs.sparkSession
    home = S.workspace(spark, "decontam")
    per_item = S.saved(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_windows(width), "window binary, words binary, item_id string"), f"{home}/items")
    windows = S.saved(per_item.groupBy("window", "words").agg(F.to_json(F.sort_array(F.collect_set("item_id"))).alias("items")), f"{home}/windows")
    shards = max(1, -(-windows.count() // WINDOWS_PER_SHARD))
    only = windows.select("words")
    vocab, stats = S.build(only.mapInArrow(_shingle_rows(run, shards), "shard int, k int, key long"), shards, _keys, f"{home}/vocab")
    ks = sorted({k for x in stats for k in x["k"]})
    text = docs.select("text")
    counts = text.mapInArrow(_counts(vocab, shards, ks), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    def sorted_counts(shard, t):
        order = np.argsort(t.column("key").to_numpy())
        return {"key": t.column("key").to_numpy()[order], "n": t.column("n").to_numpy()[order]}

    def dealt(batches):
        for b in batches:
            key = b.column("key").to_numpy().view(X.U)
            yield pa.RecordBatch.from_arrays([pa.array(_shard(key, shards)), b.column("key"), b.column("n")], ["shard", "key", "n"])

    freq, _ = S.build(counts.mapInArrow(dealt, "shard int, key long, n long"), shards, sorted_counts, f"{home}/freq")
    index, _ = S.build(windows.select("words", "items").mapInArrow(_anchors(freq, shards, run), "shard int, k int, key long, at int, words binary, items string"), shards, _index, f"{home}/index")
    keep = [c for c in docs.columns if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + RESULT.fields)
    return docs.select(keep).mapInArrow(_judge(index, shards, ks, share, keep), schema)
