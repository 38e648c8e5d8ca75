"""Interpolated modified Kneser-Ney n-gram model of order 2 or 3, counted in Spark and kept in sorted arrays that workers map.

The first pass over the training texts counts words into a vocabulary sorted by 64-bit hash, in shards; a word's id
is its place. The second counts the n-grams of the highest order as (context, word), where a context packs the ids
before the word, in shards by the context's hash. A context of very common words is hot: its words are
dealt to all shards, and its sums are gathered apart. Lower orders come from the arrays of the order above alone: a
n-gram's count there is the number of different words before it. Each batch counts what it has before anything
is shuffled. A model may be of any size: a lookup opens only the shards that it hits and reads the pages that it needs, and
the driver holds totals and shard sizes.

p(w | context) = (c - D(c) + (D1 n1 + D2 n2 + D3 n3+) p(w | shorter context)) / sum of c over the context, where c is the count
of the context's n-gram with w, n1, n2 and n3+ the context's words of these counts; without the context the shorter one decides. Below
the words' own numbers of words before them lies 1 / (V + 1), where the 1 is for unknown words. Every text has order - 1
starts before its first and an end, a token, after its last word. No count is cut off.

Nulls and edges: a null text is empty and has one token, the end; a null id is no held-out one; repeated rows count
again; without training texts every score and base score is 0 (one kind of token of chance 1); an empty table gives an empty
one; 2^31 different words or more raise ValueError. Incoming columns named like a result are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store as S
from . import _text as X

END = X.U(0x5BD1E995C6A4A793)
WORDS_PER_SHARD = 2_000_000
#: A word with fewer training tokens never makes a context hot.
LEAST_HEAVY = 1000
RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, and offsets."""
    h, off = X.words(texts)
    out = np.full(len(h) + len(off) - 1, END, X.U)
    to = off + np.arange(len(off))
    place = np.ones(len(out), bool)
    place[to[1:] - 1] = False
    out[place] = h
    return out, to


def discounts(n: list[int]) -> np.ndarray:
    """D of a count of 0, 1, 2 and 3 or more, from how many have the counts 1 to 4."""
    n1, n2, n3, n4 = (max(x, 1e-9) for x in n)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d))])


@dataclass
class Level:
    """The n-grams of one order. grams, by shard: key (contexts in order), off, w (each context's words in order), n. sums: of hot contexts."""

    grams: S.Store
    sums: S.Store
    shards: int
    d: np.ndarray

    def look(self, key: np.ndarray, first: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (sum, n1, n2, n3+) of contexts, zero for unknown ones, and the counts of words after them: those after context i are
        w[first[i] : first[i + 1]]. The keys of cold contexts rise, as do those of hot ones.

        A shard is asked once, for its cold contexts with all their words and for the words of hot ones that it was dealt.
        """
        totals, counts = np.zeros((len(key), 4), np.int64), np.zeros(len(w), np.int64)
        size = np.diff(first)
        hot, cold = np.flatnonzero(key >= HOT), np.flatnonzero(key < HOT)
        dealt, owner = spread(first[hot], size[hot]), np.repeat(hot, size[hot])
        probe = np.concatenate([key[cold], key[owner]])
        begin, many = np.concatenate([first[cold], dealt]), np.concatenate([size[cold], np.ones(len(dealt), np.int64)])
        for s, at in by_shard(np.concatenate([gram_shard(key[cold], None, self.shards), gram_shard(key[owner], w[dealt], self.shards)]), self.grams.sizes):
            a = self.grams.arrays(s)
            at, pos = rising_hits(a["key"], probe[at], at)
            lo, hi = a["off"][pos].astype(np.int64), a["off"][pos + 1].astype(np.int64)
            own = np.searchsorted(at, len(cold))  # the cold ones come first
            totals[cold[at[:own]]] = sums_at(a, pos[:own], lo[:own], hi[:own])
            asked = spread(begin[at], many[at])
            lo, end, words, want = np.repeat(lo, many[at]), np.repeat(hi, many[at]), a["w"], w[asked]
            hi = end.copy()
            busy = np.flatnonzero(lo < hi)
            while len(busy):  # a binary search in all slices at once
                mid = (lo[busy] + hi[busy]) >> 1
                less = words[mid] < want[busy]
                lo[busy[less]], hi[busy[~less]] = mid[less] + 1, mid[~less]
                busy = busy[lo[busy] < hi[busy]]
            hit = np.flatnonzero(lo < end)
            hit = hit[words[lo[hit]] == want[hit]]
            counts[asked[hit]] = counts_at(a, lo[hit])
        for s, at in by_shard(gram_shard(key[hot], None, self.shards, True), self.sums.sizes):
            a = self.sums.arrays(s)
            at, pos = rising_hits(a["key"], key[hot[at]], at)
            totals[hot[at]] = a["sums"][pos]
        return totals, counts


#: The bit of a context's key that tells that it's hot. Ids are below 2^31, so it is free.
HOT = X.U(1) << X.U(63)
#: The sums of contexts with more words than this are stored, others are added up from their words.
WIDE = 16
LOW32 = X.U(0xFFFFFFFF)


def by_shard(of: np.ndarray, sizes: dict[int, int]):
    """(shard, places) of each shard that is hit and there."""
    if not len(of):
        return
    if of.max() < 1 << 16:  # short integers are sorted by their digits
        of = of.astype(np.uint16)
    order = np.argsort(of, kind="stable")
    of = of[order]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    for s, a, b in zip(of[starts].tolist(), starts, np.append(starts, len(order))[1:], strict=True):
        if s in sizes:
            yield s, order[a:b]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def rising_hits(keys: np.ndarray, probe: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rising probes those that the sorted keys have: their `at`, and their places."""
    pos = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    hit = np.flatnonzero(keys[pos] == probe)
    return at[hit], pos[hit]


def gram_shard(key: np.ndarray, w: np.ndarray | None, shards: int, sums: bool = False) -> np.ndarray:
    """By the context, or in a hot one, but for its sums, by the word too."""
    h = X.mix(key)
    if w is not None and not sums:
        h = np.where(key >= HOT, X.mix(h + w.astype(X.U) * X.GOLD), h)
    return (h % X.U(shards)).astype(np.int32)


def sums_of(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (sum, n1, n2, n3+) of runs of counts that begin at `first`."""
    return np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n >= 3)], 1) if len(n) else np.zeros((0, 4), np.int64)


def counts_at(a: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    n = a["n"][at].astype(np.int64)
    large = np.flatnonzero(n == 255)
    n[large] = a["large"][np.searchsorted(a["large_at"], at[large])]
    return n


def sums_at(a: dict[str, np.ndarray], pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows (sum, n1, n2, n3+) of a shard's contexts with words from lo to hi."""
    out, size = np.empty((len(pos), 4), np.int64), hi - lo
    wide, few = np.flatnonzero(size > WIDE), np.flatnonzero(size <= WIDE)
    out[wide] = a["wide"][np.searchsorted(a["wide_at"], pos[wide])]
    out[few] = sums_of(counts_at(a, spread(lo[few], size[few])), np.cumsum(size[few]) - size[few])
    return out


@dataclass
class Grams:
    """A batch's different n-grams of one order, in the order of context and last word."""

    context: np.ndarray  # of each: its context, of those in key and known
    last: np.ndarray  # of each: its last word, of the batch's different words
    below: np.ndarray  # of each: the n-gram, or word, without the first word, of those of the order below
    place: np.ndarray  # of each token: the n-gram that ends there
    key: np.ndarray  # of contexts
    known: np.ndarray  # of contexts: whether all words are known


@dataclass
class Model:
    order: int
    vocab: S.Store
    shards: int
    offsets: np.ndarray  # of each shard's ids; the last is V, the id of the start
    heavy: int
    total: int  # training tokens
    texts: int
    before: S.Store  # of each id, how many different words go before it
    levels: dict[int, Level] = field(default_factory=dict)
    d_low: np.ndarray = field(default_factory=lambda: discounts([0] * 4))
    low: list[int] = field(default_factory=lambda: [0] * 3)  # words that have 1, 2 and 3 or more different words before them
    low_total: int = 0

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of distinct hashes in rising order."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for s, at in by_shard(vocab_shard(h, self.shards), self.vocab.sizes):
            a = self.vocab.arrays(s)
            at, pos = rising_hits(a["key"], h[at], at)
            ids[at], counts[at] = pos + self.offsets[s], a["c"][pos]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of ids; the start has one for each text."""
        out = np.full(len(ids), self.texts, np.int64)
        for s, at in by_shard(np.searchsorted(self.offsets, ids, "right") - 1, self.vocab.sizes):
            out[at] = self.vocab.arrays(s)["c"][ids[at] - self.offsets[s]]
        return out

    def befores(self, ids: np.ndarray) -> np.ndarray:
        out, known = np.zeros(len(ids), np.int64), np.flatnonzero(ids >= 0)
        for s, at in by_shard(np.searchsorted(self.offsets, ids[known], "right") - 1, self.before.sizes):
            at = known[at]
            out[at] = self.before.arrays(s)["n"][ids[at] - self.offsets[s]]
        return out

    def grams(self, ids: np.ndarray, c: np.ndarray, at: np.ndarray, off: np.ndarray):
        """The n-grams of order 2 and up of texts; at: each token's place among the different words, whose ids and counts are given."""
        raw, known, least, place = np.append(ids, self.size), np.append(ids >= 0, True), np.append(c, self.texts), at
        for n in range(2, self.order + 1):
            context = np.empty_like(place)
            context[1:] = place[:-1]
            context[off[:-1]] = len(raw) - 1  # only starts
            code, held = np.unique(context * len(ids) + at, return_inverse=True)
            context, last = np.divmod(code, len(ids))
            below = np.empty(len(code), np.int64)
            below[held] = place
            place = held
            yield Grams(context, last, below, place, key_of(raw, least >= self.heavy), known)
            if n < self.order:  # the contexts of the next order
                raw = np.append(raw[context] << 32 | ids[last] & 0xFFFFFFFF, self.size << 32 | self.size)
                known = np.append(known[context] & (ids[last] >= 0), True)
                least = np.append(np.minimum(least[context], c[last]), self.texts)

    def score(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each text: known tokens, base score, score."""
        u, at = np.unique(h, return_inverse=True)
        ids, c = self.ids(u)
        n, kinds = self.befores(ids), self.size + 1
        base = np.log10((c + 1) / (self.total + kinds))
        low = np.maximum(n - self.d_low[np.minimum(n, 3)], 0) / max(1, self.low_total)
        left = float(self.d_low[1:] @ np.array(self.low)) / self.low_total if self.low_total else 1.0
        p, place = low + left / kinds, at
        for (_, level), g in zip(sorted(self.levels.items()), self.grams(ids, c, at, off), strict=True):
            some = np.flatnonzero(np.concatenate([[True], g.context[1:] != g.context[:-1]]))
            some = g.context[some][g.known[g.context[some]]]
            asked = np.flatnonzero(g.known[g.context] & (ids[g.last] >= 0))
            t, found = level.look(g.key[some], np.searchsorted(g.context[asked], np.append(some, len(g.key))), ids[g.last[asked]])
            total, rest, count = np.zeros(len(g.key), np.int64), np.zeros(len(g.key)), np.zeros(len(g.last), np.int64)
            total[some], rest[some], count[asked] = t[:, 0], (t[:, 1:] @ level.d[1:]) / np.maximum(t[:, 0], 1), found
            p, place = p[g.below], g.place
            seen = np.flatnonzero(total[g.context])
            of, count = g.context[seen], count[seen]
            p[seen] = np.maximum(count - level.d[np.minimum(count, 3)], 0) / total[of] + rest[of] * p[seen]
        add = lambda v: np.add.reduceat(v, off[:-1])
        return add((c[at] > 0).astype(np.int64)), add(base[at]), add(np.log10(p)[place])


def key_of(context: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return context.astype(X.U) | np.where(hot, HOT, X.U(0))


def vocab_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Rising with the hash, so that ids follow the hashes' order over all shards."""
    return ((h >> X.U(32)) * X.U(shards) >> X.U(32)).astype(np.int32)


def _words(shards: int):
    def f(batches):
        for b in X.pieces(batches):
            h, _ = tokens(b.column("text"))
            key, n = X.sum_runs(h, np.ones(len(h), np.int64))
            yield from S.blocks(vocab_shard(key, shards), key, n.astype(np.uint32), rising=True)

    return f


def _vocab(shard, t):
    key, n = X.sum_runs(*S.unblock(t, X.U, np.uint32, rising=True))
    return {"key": key, "c": n.astype(np.int64), "stats": {"tokens": int(n.sum())}}


def summed(key: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, w) in order, with their sums."""
    order = np.lexsort((w, key))
    key, w = key[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (w[1:] != w[:-1])])) if len(key) else np.zeros(0, np.int64)
    return key[first], w[first], np.add.reduceat(n[order], first) if len(key) else n


def _grams(m: Model):
    def f(batches):
        for b in X.pieces(batches):
            if not b.num_rows:
                continue
            h, off = tokens(b.column("text"))
            u, at = np.unique(h, return_inverse=True)
            ids, c = m.ids(u)
            *_, g = m.grams(ids, c, at, off)
            key, n = g.key[g.context], np.bincount(g.place)
            order = np.concatenate([np.flatnonzero(key < HOT), np.flatnonzero(key >= HOT)])  # rising keys
            key, w, n = key[order], ids[g.last[order]].astype(np.uint32), n[order]
            yield from S.blocks(gram_shard(key, w, m.shards), key, w, n.astype(np.uint32), rising=True)

    return f


def _arrays(shard, t):
    key, w, n = summed(*S.unblock(t, X.U, np.uint32, np.uint32, rising=True))
    n = n.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    off = np.append(first, len(key))
    wide, large = np.flatnonzero(np.diff(off) > WIDE), np.flatnonzero(n >= 255)
    small = np.uint32 if len(key) < 1 << 32 else np.uint64
    stats = {str(k): int((n == k).sum()) for k in (1, 2, 3, 4)}
    return {"key": key[first], "off": off.astype(small), "w": w, "n": np.minimum(n, 255).astype(np.uint8), "large_at": large, "large": n[large], "wide_at": wide, "wide": sums_of(n, first)[wide] if len(key) else np.zeros((0, 4), np.int64), "stats": stats}


def _stored(grams: S.Store, shard: int) -> tuple[np.ndarray, ...]:
    """A shard's n-grams: (key, w, n)."""
    a = grams.arrays(shard)
    size = np.diff(a["off"].astype(np.int64))
    return np.repeat(a["key"], size), a["w"], counts_at(a, np.arange(int(size.sum())))


def _each(grams: S.Store, use):
    def f(batches):
        for b in batches:
            for s in b.column("id").to_pylist():
                if s in grams.sizes:
                    yield from use(*_stored(grams, s))

    return f


def _shorter(m: Model):
    """From n-grams (u v, w) those of (v, w), each with how many u it has in the shard."""

    def use(key, w, n):
        v = (key & LOW32).astype(np.int64)
        kinds, place = np.unique(v, return_inverse=True)
        hot = m.counts(kinds) >= m.heavy
        key, w, n = summed(key_of(v, hot[place]), w, np.ones(len(w), np.int64))
        yield from S.blocks(gram_shard(key, w, m.shards), key, w, n.astype(np.uint32), rising=True)

    return use


def _hot_sums(shards: int):
    def use(key, w, n):
        hot = np.flatnonzero(key >= HOT)
        key, n = key[hot], n[hot]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        yield from S.blocks(gram_shard(key[first], None, shards, True), key[first], *sums_of(n, first).T)

    return use


def _sum_arrays(shard, t):
    key, *cols = X.sum_runs(*S.unblock(t, X.U, *[np.int64] * 4))
    return {"key": key, "sums": np.stack(cols, 1)}


def _befores(m: Model):
    def use(key, w, n):
        w, k = X.sum_runs(w.astype(np.int64), np.ones(len(w), np.int64))
        shard = np.searchsorted(m.offsets, w, "right") - 1
        yield from S.blocks(shard.astype(np.int32), (w - m.offsets[shard]).astype(np.uint32), k.astype(np.uint32))

    return use


def _before_arrays(sizes: list[int]):
    def f(shard, t):
        at, n = S.unblock(t, np.uint32, np.uint32)
        before = np.bincount(at.astype(np.int64), n, sizes[shard]).astype(np.int64)
        return {"key": np.zeros(len(before), bool), "n": before, "stats": {"total": int(before.sum()), "more": int((before >= 3).sum()), **{str(k): int((before == k).sum()) for k in (1, 2, 3, 4)}}}

    return f


def train(texts: DataFrame, *, order: int = 3) -> Model:
    """A model of the column `text`."""
    if order not in (2, 3):
        raise ValueError(f"order must be 2 or 3, not {order}")
    spark = texts.sparkSession
    home = S.workspace(spark, "lm")
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    about = texts.agg(F.count("*").alias("n"), (F.sum(F.length("text")) / 6).alias("w")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((about.w or 0) / WORDS_PER_SHARD) + 1)
    vocab, stats = S.build(texts.mapInArrow(_words(shards), S.BLOCKS), shards, _vocab, f"{home}/vocab", together=True)
    offsets = np.concatenate([[0], np.cumsum([vocab.sizes.get(s, 0) for s in range(shards)])]).astype(np.int64)
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2^31 different words")
    total = sum(s["tokens"] for s in stats)
    m = Model(order, vocab, shards, offsets, max(LEAST_HEAVY, total // (20 * shards)), total, about.n, S.Store("", {}))
    sums = lambda stats, k: sum(s[k] for s in stats)
    every = spark.range(0, shards, 1, shards)
    blocks = texts.mapInArrow(_grams(m), S.BLOCKS)
    for n in range(order, 1, -1):
        grams, stats = S.build(blocks, shards, _arrays, f"{home}/grams{n}", together=True)
        hot, _ = S.build(every.mapInArrow(_each(grams, _hot_sums(shards)), S.BLOCKS), shards, _sum_arrays, f"{home}/sums{n}", together=True)
        m.levels[n] = Level(grams, hot, shards, discounts([sums(stats, k) for k in "1234"]))
        blocks = every.mapInArrow(_each(grams, _shorter(m) if n > 2 else _befores(m)), S.BLOCKS)
    m.before, stats = S.build(blocks, shards, _before_arrays(np.diff(offsets).tolist()), f"{home}/before", together=True)
    m.d_low = discounts([sums(stats, k) for k in "1234"])
    m.low, m.low_total = [sums(stats, "1"), sums(stats, "2"), sums(stats, "more")], sums(stats, "total")
    return m


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability)."""
    keep = [c for c in docs.columns if c not in RESULT.names]

    def f(batches):
        for b in X.pieces(batches):
            h, off = tokens(b.column("text"))
            known, base, score = model.score(h, off) if b.num_rows else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.diff(off)), pa.array(known), pa.array(np.full(b.num_rows, model.total)), pa.array(base), pa.array(score)], [*keep, *RESULT.names])

    return docs.select(keep).mapInArrow(f, T.StructType([docs.schema[c] for c in keep] + RESULT.fields))
