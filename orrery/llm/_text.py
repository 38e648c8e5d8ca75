"""Vectorised tokenising of Arrow string columns.

A batch of texts is one byte buffer. Words are runs of non-separator bytes, found for the whole buffer
at once, and each is hashed to 64 bits by eight-byte steps, so no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
MUL1, MUL2, GOLD = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x9E3779B97F4A7C15)


def _table(separators: set[int], lower: bool) -> bytes:
    return bytes(32 if b in separators else b + 32 if lower and 65 <= b <= 90 else b for b in range(256))


#: Words [^\x20\x09-\x0D]+ with A-Z lower-cased.
SPACED = _table({32, *range(9, 14)}, True)
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z is lower-cased: a-z, 0-9 and all that isn't ASCII.
ALNUM = _table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}, True)


def buffer(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return b"", np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (data.to_pybytes() if data is not None else b"")[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> U(33))
    x = x * MUL1
    x = x ^ (x >> U(33))
    x = x * MUL2
    return x ^ (x >> U(33))


def spans(data: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, where byte 32 separates; a word never passes the end of its text."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.frombuffer(data, np.uint8) != 32
    edge = np.empty(len(word) + 1, bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    cut = off[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(word))])
    cut = cut[word[cut] & word[cut - 1]]
    at = np.flatnonzero(edge)
    if len(cut):  # a word ends and another begins there
        at = np.sort(np.concatenate([at, cut, cut]))
    return at[::2], at[1::2]


def hash_spans(data: bytes, st: np.ndarray, en: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    pad = np.frombuffer(data + bytes(16), np.uint8)
    eight = np.lib.stride_tricks.as_strided(pad[:8].view(U), (len(data) + 1,), (1,))
    rem = en - st
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)
    h = rem.astype(U) * GOLD
    v = eight[st] & masks[np.minimum(rem, 8)]
    h = (h ^ v) * MUL1
    h ^= h >> U(32)
    idx = np.flatnonzero(rem > 8)
    pos, left = st[idx] + 8, rem[idx] - 8
    while len(idx):
        v = eight[pos] & masks[np.minimum(left, 8)]
        x = (h[idx] ^ v) * MUL1
        h[idx] = x ^ (x >> U(32))
        go = left > 8
        idx, pos, left = idx[go], pos[go] + 8, left[go] - 8
    return mix(h)


def words(texts: pa.Array, table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and len + 1 offsets of each text's words."""
    data, off = buffer(texts)
    data = data.translate(table)
    hashes, counts, at = [], [], 0
    while at < len(off) - 1:  # blocks of about a megabyte stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(off, off[at] + (1 << 20))))
        to = min(to, len(off) - 1)
        part, local = data[off[at] : off[to]], off[at : to + 1] - off[at]
        st, en = spans(part, local)
        hashes.append(hash_spans(part, st, en))
        counts.append(np.diff(np.searchsorted(st, local)))
        at = to
    return np.concatenate([np.zeros(0, U), *hashes]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *counts]))]).astype(np.int64)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, a shorter text's whole sequence as one; and their offsets."""
    n = np.diff(off)
    counts = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    out_off = np.concatenate([[0], np.cumsum(counts)])
    if not len(h):
        return np.zeros(0, U), out_off
    run = h.copy()
    for i in range(1, k):
        run[: len(h) - i] = mix(run[: len(h) - i] * GOLD + h[i:])
    owner = np.repeat(np.arange(len(n)), counts)
    out = run[np.minimum(off[owner] + np.arange(out_off[-1]) - out_off[owner], len(h) - 1)]
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = h[off[d] : off[d + 1]]
        acc = x[:1].copy()
        for y in x[1:]:
            acc = mix(acc * GOLD + y)
        out[out_off[d]] = (acc ^ U(n[d]))[0] if n[d] < k else acc[0]
    return out, out_off


def distinct(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and their offsets."""
    x = x.copy()
    for a, b in zip(off[:-1], off[1:], strict=True):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    starts = off[:-1]
    keep[starts[starts < off[1:]]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[off]


def sum_runs(keys: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in rising order, with each column's sums."""
    if not len(keys):
        return keys, *cols
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(c[order], first) for c in cols)


def pieces(batches, column: str = "text", most: int = 6 << 20):
    """Record batches cut so that a column's bytes stay below a bound, or a single row is left."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        col = b.column(column).cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < b.num_rows:
            to = min(b.num_rows, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
            yield b.slice(at, to - at)
            at = to
