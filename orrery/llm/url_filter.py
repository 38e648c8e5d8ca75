"""URL rules in a sorted digest array: 64-bit xxhash keys, memory-mapped and probed by binary search.

A rule is (host, path prefix, verdict). Its key is the hash of host, a zero byte and path. A URL is probed
with the suffixes of its host at label bounds and the prefixes of its path whose lengths some rule has, the longest
first, so a host of any length costs as many probes as rules have lengths; a hit is confirmed against the stored strings, so equal hashes of different rules do no harm. The
array is built by tasks in shards by hash and shared as files: it may have any size.

The longest rule wins, by host and path together, then by its host; of equal rules, allow. A URL that no
rule fits gets the default verdict.

Nulls and edges: a null URL, or one without "://", has an empty host and path, fits a rule only if a rule has
an empty host, and else gets the default; repeated rows are judged each; an empty table gives an empty one, no rules give all
the default; a rule with a null host or path takes it as empty; a null verdict is block.
Incoming columns named like a result are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store as S

RULES_PER_SHARD = 1_000_000
RESULT = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
LOWER = {c: c + 32 for c in range(65, 91)}


def host_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in (tail.find("?"), tail.find("#")) if i >= 0), default=len(tail))
    return rest[:end].translate(LOWER), tail[:stop]


def digest(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\0{path}".encode())


def _suffixes(host: str, lengths: list[int]) -> list[str]:
    """The host and its parents, those of a length that some rule's host has."""
    return [host[len(host) - n :] for n in lengths if n == len(host) or (0 < n < len(host) and host[len(host) - n - 1] == ".")]


def _rule_rows(shards: int):
    def f(batches):
        for b in batches:
            rules = [(h or "", p or "", v or "block") for h, p, v in zip(*(b.column(c).to_pylist() for c in ("host", "path", "verdict")), strict=True)]
            rules = [(h.translate(LOWER), p, v) for h, p, v in rules]
            key = np.array([digest(h, p) for h, p, _ in rules], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(shards)).astype(np.int32)), pa.array(key.view(np.int64)), *(pa.array([r[i] for r in rules], pa.string()) for i in range(3))], ["shard", "key", "host", "path", "verdict"])

    return f


def _sorted_rules(shard, t):
    keys = t.column("key").to_numpy().view(np.uint64)
    host, path, verdict = (t.column(c).to_pylist() for c in ("host", "path", "verdict"))
    rows = sorted({(int(k), h, p, v) for k, h, p, v in zip(keys.tolist(), host, path, verdict, strict=True)}, key=lambda r: (*r[:3], r[3] != "allow", r[3]))
    best = [r for i, r in enumerate(rows) if not i or r[:3] != rows[i - 1][:3]]
    texts = [x.encode() for _, h, p, v in best for x in (f"{h}\0", f"{p}\0", v)]
    stats = {"hosts": sorted({len(r[1]) for r in best}), "paths": sorted({len(r[2]) for r in best})}
    return {"key": np.array([r[0] for r in best], np.uint64), "texts": np.frombuffer(b"".join(texts), np.uint8), "off": np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64), "stats": stats}


def _judge(store: S.Store, shards: int, hosts: list[int], paths: list[int], default: str, keep: list[str]):
    def f(batches):
        for b in batches:
            parts = [host_path(u) for u in b.column("url").to_pylist()]
            probes, owner = [], []
            for i, (host, path) in enumerate(parts):
                for h in _suffixes(host, hosts):
                    for n in paths:
                        if n <= len(path):
                            probes.append((h, path[:n]))
                            owner.append(i)
            key = np.array([digest(h, p) for h, p in probes], np.uint64)
            of = key % np.uint64(shards)
            hit = np.full(len(key), -1, np.int64)
            for s in store.sizes.keys() & set(of.tolist()):
                mine = np.flatnonzero(of == s)
                hit[mine] = S.find(store.array(s, "key"), key[mine])
            best: list[tuple] = [(-1, -1, None, default)] * len(parts)
            for j in np.flatnonzero(hit >= 0):
                s, (h, p) = int(of[j]), probes[j]
                keys, off, texts = store.array(s, "key"), store.array(s, "off"), store.array(s, "texts")
                at = int(np.searchsorted(keys, key[j]))
                while at < len(keys) and keys[at] == key[j]:
                    host, path, verdict = (texts[off[3 * at + i] : off[3 * at + i + 1]].tobytes().decode() for i in range(3))
                    if (host[:-1], path[:-1]) == (h, p):
                        best[owner[j]] = max(best[owner[j]], (len(h) + len(p), len(h), h + p, verdict), key=lambda x: x[:2])
                        break
                    at += 1
            rule, verdict = [x[2] for x in best], [x[3] for x in best]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*keep, *RESULT.names])

    return f


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """pages(url, ...) with host, path, rule (host and path of the one that won, else null) and verdict.

    rules: host, path, verdict (allow or block).
    """
    home = S.workspace(pages.sparkSession, "urls")
    shards = max(1, -(-rules.count() // RULES_PER_SHARD))
    rows = rules.select(*(F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict"))).mapInArrow(_rule_rows(shards), "shard int, key long, host string, path string, verdict string")
    store, stats = S.build(rows, shards, _sorted_rules, f"{home}/rules")
    hosts, paths = (sorted({n for x in stats for n in x[k]}, reverse=True) for k in ("hosts", "paths"))
    keep = [c for c in pages.columns if c not in RESULT.names]
    schema = T.StructType([pages.schema[c] for c in keep] + RESULT.fields)
    return pages.select(keep).mapInArrow(_judge(store, shards, hosts, paths, default, keep), schema)
