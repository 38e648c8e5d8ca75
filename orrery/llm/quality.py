"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Boosting visits the features in turn, round after
round; each visit fits one shallow tree to the gradient over the feature's bins and adds a small step of it to
the feature's lookup table. Then the pairs with the largest remaining structure get two-way tables in the same
manner. A score is the logistic of an intercept and one table entry for each feature and pair: binning, lookups
and additions of whole columns.

The model is fitted on the driver to at most `most_rows` labelled rows, those with the least hash of their
id; its size depends on bins and features only. Every row of the corpus is scored. Labels, language, source and
id are no features.

Nulls and edges: a null text counts as empty, and an empty text has features and a score like any other; rows
without an id can be scored but not learnt from; of several labels of one document the least counts, null ones
don't; of several texts of one document one is learnt from; without labels of both kinds every score is the share of label 1 (0.5 without any). Incoming columns
named like a result are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X

#: Classes of bytes for the shares among the features.
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:?'-\"()", "bang": b"!", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "line": b"\n", "space": b" \t\r\x0b\x0c", "high": range(128, 256)}
CODE = bytes(next((i for i, c in enumerate(CLASSES.values(), 1) if b in c), 0) for b in range(256))
FEATURES = [*CLASSES, "bytes", "words", "word_bytes", "short_words", "longest_word", "distinct_words", "repeated_runs", "line_bytes", "ends"]


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    data, off = X.buffer(texts)
    codes = np.frombuffer(data.translate(CODE), np.uint8)
    size = np.diff(off)
    shares = np.zeros((len(size), len(CLASSES) + 1))
    for i, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
        shares[i] = np.bincount(codes[a:b], minlength=len(CLASSES) + 1)
    lines = shares[:, list(CLASSES).index("line") + 1]
    h, w_off = X.words(texts)
    n = np.diff(w_off)
    st, en = X.spans(data.translate(X.SPACED), off)
    length = en - st
    pad = lambda v: np.concatenate([[0], np.cumsum(v)])
    total = lambda v: pad(v)[w_off[1:]] - pad(v)[w_off[:-1]]
    longest = np.zeros(len(n))
    full = n > 0
    if full.any():
        longest[full] = np.maximum.reduceat(length, w_off[:-1][full])
    ends = np.frombuffer(data, np.uint8)[en - 1] if len(en) else np.zeros(0, np.uint8)
    word_set = np.diff(X.distinct(h, w_off)[1])
    runs, run_off = X.shingles(h, w_off, 3)
    run_set = np.diff(X.distinct(runs, run_off)[1])
    per = lambda v, m: v / np.maximum(m, 1)
    cols = [*(per(shares[:, i + 1], size) for i in range(len(CLASSES))), np.log1p(size), np.log1p(n), per(total(length), n), per(total(length <= 3), n), np.log1p(longest), per(word_set, n), 1 - per(run_set, np.diff(run_off)), np.log1p(per(size, lines + 1)), per(total((ends == 46) | (ends == 44)), n)]
    return np.stack(cols, 1)


@dataclass
class Model:
    cuts: list[np.ndarray]
    start: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.start)
        for j, t in enumerate(self.single):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.double, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A depth-limited regression tree over ordered bins: each bin's value."""
    out = np.zeros(len(grad))

    def grow(a: int, b: int, d: int) -> None:
        g, h = grad[a:b].cumsum(), hess[a:b].cumsum()
        out[a:b] = g[-1] / (h[-1] + ridge)
        if d and b - a > 1:
            left = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
            k = int(left.argmax())
            if left[k] > g[-1] ** 2 / (h[-1] + ridge) + 1e-9:
                grow(a, a + k + 1, d - 1)
                grow(a + k + 1, b, d - 1)

    grow(0, len(grad), depth)
    return out


def _tree2(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """A cut along one feature and, on each side of it, one along the other: each cell's value."""
    best, out = -np.inf, None
    for axis in (0, 1):
        g, h = (grad, hess) if axis == 0 else (grad.T, hess.T)
        gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        for k in range(len(g) - 1):
            total, cut = 0.0, []
            for ga, ha in ((gc[k], hc[k]), (gc[-1] - gc[k], hc[-1] - hc[k])):
                gain = ga**2 / (ha + ridge) + (ga[-1] - ga) ** 2 / (ha[-1] - ha + ridge)
                m = int(gain.argmax())
                total += gain[m]
                cut.append((m, ga[m] / (ha[m] + ridge), (ga[-1] - ga[m]) / (ha[-1] - ha[m] + ridge)))
            if total > best:
                best, t = total, np.zeros_like(g)
                for rows, (m, lo, hi) in zip((slice(0, k + 1), slice(k + 1, None)), cut, strict=True):
                    t[rows, : m + 1], t[rows, m + 1 :] = lo, hi
                out = t if axis == 0 else t.T
    return np.zeros_like(grad) if out is None else out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 150, rate: float = 0.1, depth: int = 2, pairs: int = 6, pair_rounds: int = 30, ridge: float = 1.0) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        start = float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3))))
        return Model([np.zeros(0)] * len(FEATURES), start, [np.zeros(1)] * len(FEATURES))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    m = Model(cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    b = m.bins(x)
    z = np.full(len(y), m.start)
    slopes = lambda: ((p := 1 / (1 + np.exp(-z))), y - p, p * (1 - p))[1:]
    for _ in range(rounds):
        for j, t in enumerate(m.single):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), depth, ridge)
            t += step
            z += step[b[:, j]]
    grid = lambda i, j, v: np.bincount(b[:, i] * len(m.single[j]) + b[:, j], v, len(m.single[i]) * len(m.single[j])).reshape(len(m.single[i]), -1)
    g, h = slopes()
    gain = []
    for i in range(x.shape[1]):
        for j in range(i):
            gg, hh = grid(i, j, g), grid(i, j, h)
            t = _tree2(gg, hh, ridge)
            gain.append((float((t * gg).sum()), i, j))
    m.pairs = [(i, j) for _, i, j in sorted(gain, reverse=True)[:pairs]]
    m.double = [np.zeros((len(m.single[i]), len(m.single[j]))) for i, j in m.pairs]
    for _ in range(pair_rounds):
        for (i, j), t in zip(m.pairs, m.double, strict=True):
            g, h = slopes()
            step = rate * _tree2(grid(i, j, g), grid(i, j, h), ridge)
            t += step
            z += step[b[:, i], b[:, j]]
    return m


def train(docs: DataFrame, labels: DataFrame, held_out: Column, *, most_rows: int = 20_000) -> Model:
    """A model from labels(doc_id, quality) of documents for which held_out(doc_id) isn't true."""
    few = labels.where("doc_id is not null and quality is not null").where(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")  # bounded by most_rows

    def f(batches):
        for b in X.pieces(batches):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("quality").cast(pa.int32()), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", "quality", *FEATURES])

    every = rows.mapInArrow(f, T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("quality", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in FEATURES)]))
    # one row for each label reaches the driver, however many rows have its doc_id: the least by its features
    got = every.groupBy("doc_id").agg(F.min(F.struct("quality", *FEATURES)).alias("one")).select("doc_id", "one.*").toArrow()
    got = got.sort_by([("doc_id", "ascending"), *((n, "ascending") for n in FEATURES)])
    x = np.stack([got.column(n).to_numpy() for n in FEATURES], 1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, (got.column("quality").to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs(text, ...) with score."""
    keep = [c for c in docs.columns if c != "score"]

    def f(batches):
        for b in X.pieces(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(model.score(features(b.column("text"))) if b.num_rows else [], pa.float64())], [*keep, "score"])

    return docs.select(keep).mapInArrow(f, T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())]))


def fold(doc_id: str, folds: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == rest, F.lit(False))
