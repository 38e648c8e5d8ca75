"""Best-fit packing of documents into sequences of several permitted lengths.

A document's tokens are its words and one end. A document longer than the longest sequence is cut into pieces of that
length and a rest. Pieces are dealt by hash into groups of about `group` pieces, each packed by one task: in
falling size, a piece goes into the open bin that it leaves the least room in; if none has room, a bin is
opened, of the length that costs least when what is likely to fill its room is taken off at the best price for
a token. What is likely to fill it is known: the tokens of the remaining pieces that are small enough.
At the end each bin is cut down to the least permitted length that holds its contents.

Nulls and edges: a null or empty text has one token, its end; a null id is packed like any other; repeated rows are
packed each; an empty table gives an empty one; ids are whole numbers (a text that is none raises); other columns are left
out; pieces of equal size go by id, then by place, so equal input gives equal bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store as S
from . import _text as X

LENGTHS = (256, 512, 1024, 2048, 4096)


def price(length: int, longest: int) -> float:
    """What a sequence costs: its tokens, and attention among them."""
    return length * (1 + length / (4 * longest))


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, offset, length of the bin) of each size; sizes fall and none is above the longest length."""
    lengths = tuple(sorted(lengths))
    cost = {n: price(n, lengths[-1]) for n in lengths}
    token = min(cost[n] / n for n in lengths)
    rising = sizes[::-1]
    before = [0, *np.cumsum(rising).tolist()]
    open_: list[tuple[int, int]] = []  # (room, bin)
    used: list[int] = []
    places = []
    for i, size in enumerate(sizes):
        k = bisect_left(open_, (size, -1))
        if k < len(open_):
            room, bin_ = open_.pop(k)
        else:
            left = len(sizes) - i - 1  # the remaining pieces are the first of `rising`
            likely = lambda room, left=left: min(room, before[min(left, bisect_right(rising, room))])
            room = min((n for n in lengths if n >= size), key=lambda n: (cost[n] - token * likely(n - size)) / (size + likely(n - size)))
            bin_ = len(used)
            used.append(0)
        places.append((bin_, used[bin_]))
        used[bin_] += size
        if room > size:
            insort(open_, (room - size, bin_))
    final = [lengths[bisect_left(lengths, n)] for n in used]
    return [(b, at, final[b]) for b, at in places]


def packed(docs: DataFrame, *, lengths: tuple[int, ...] = LENGTHS, group: int = 4096) -> DataFrame:
    """docs(doc_id, text): (doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length), a row for each piece."""
    longest = max(lengths)
    home = S.workspace(docs.sparkSession, "packing")

    def cut(batches):
        for b in X.pieces(batches):
            data, off = X.buffer(b.column("text"))
            st, _ = X.spans(data.translate(X.SPACED), off)
            n = np.diff(np.searchsorted(st, off)) + 1
            parts = -(-n // longest)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(longest, n[row] - piece * longest)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), b.column("salt").take(pa.array(row)), pa.array(piece), pa.array(piece * longest), pa.array(size)], ["doc_id", "salt", "piece", "start", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.col("text")).alias("salt"), F.col("text").cast("string").alias("text"))
    pieces = S.saved(rows.mapInArrow(cut, "doc_id long, salt long, piece long, start long, n_tokens long"), f"{home}/pieces")
    groups = max(1, -(-pieces.count() // group))

    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        g, size, id_, salt, piece = (t.column(c).fill_null(-(1 << 63)).to_numpy() for c in ("g", "n_tokens", "doc_id", "salt", "piece"))
        order = np.lexsort((piece, salt, id_, -size, g))
        t, g = t.take(pa.array(order)), g[order]
        ids, starts = np.unique(g, return_index=True)
        for one, a, b in zip(ids, starts, np.append(starts, len(g))[1:], strict=True):
            part = t.slice(a, b - a).combine_chunks()
            got = best_fit(part.column("n_tokens").to_pylist(), lengths)
            cols = [part.column(c) for c in ("doc_id", "piece", "start", "n_tokens")]
            out = pa.table([*cols, pa.array([(int(one) << 32) + x for x, _, _ in got]), pa.array([x for _, x, _ in got], pa.int64()), pa.array([x for _, _, x in got], pa.int64())], ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_length"])
            yield from out.to_batches()

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "salt", "piece"), F.lit(groups)).cast("long"))
    return dealt.repartition(groups, "g").mapInArrow(pack, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long")
