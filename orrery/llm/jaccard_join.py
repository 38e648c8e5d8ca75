"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods.

A document is its set of distinct word shingles. Sizes fall into bands of ratio 1/t; linked sets lie in one
band or in neighbours, so group g holds bands g and g + 1, and bounds the symmetric difference of linked
sets by H. The universe of shingles is hashed into m segments. With p segments at allocation 1 (subset
and its one-deletion neighbourhood), the rest at 0 (subset), and m + p = H + 1 + K, linked sets agree on an
indexed value of some segment. Where p = 0, K segments may go unindexed: each set leaves out its K
commonest subsets, in one global order, and of K + 1 equal subsets the rarest stays in both. So subsets of a
passage that very many documents hold are left to the documents that have nothing else. (m, p, K) comes
from a cost model with the number of documents in the band: values written plus pairs met by chance. Deletions compete in every
group; counted on a table of 47,000 sets, they wrote 1.002 to 6.4 times the values of subsets alone in each of its 44 groups and
saved fewer pairs than the values that they added, so a plan with them is rare.

Passes over the texts: one sends the signatures to shards by hash, where those that two different
sets share are found and sent back to the batches that have them; one writes
the sets that hold such a signature to shared files, memory-mapped for verification. Each set is compared
with the least set of each of its signatures, components are formed, and only then are the remaining pairs
of one signature that lie in different components compared, so a group of near copies costs what it holds,
not its square; no link between two components is lost. Exact copies are one set throughout.

Nulls and edges: a text that is null or has no word has the empty set and links with nothing; a document with
fewer words than a shingle is one shingle; equal rows are copies; a null id takes part and its component is the
least id that isn't null, else null. Incoming columns named like a result are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _store as S
from . import _text as X
from ._graph import components

#: For the cost model alone: the chance that two unrelated documents share a shingle, and the share of
#: documents that have half of their shingles from one common passage.
CHANCE, COMMON = 0.1, 0.05
SIGNATURES_PER_SHARD = 1_000_000
#: As S.BLOCKS, with the batch that they come from: the task and its own number there.
BATCH_BLOCKS = S.BLOCKS + ", task int, batch int, print long"
#: 64-bit words for the segments that a set shares with none.
WORDS = 4
BITS = [f"u{i}" for i in range(WORDS)]
#: 64-bit words of a set's sketch, a bit for each shingle's hash: each bit in which two sketches differ stands for a
#: shingle that only one of the sets has, so the sets differ in as many at least.
SKETCH = 16


def bands(num: int, den: int, largest: int) -> list[int]:
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, edges[-1] * den // num + 1))
    return edges + [edges[-1] * den // num + 1, (edges[-1] * den // num + 1) * den // num + 1]


def allocation(edges: list[int], g: int, num: int, den: int, documents: int) -> tuple[int, int, int, int]:
    """(m, p, K, H) of group g: segments, those with deletions, commonest subsets left out, and the largest difference
    of linked sets. All 0: only equal sets link."""
    small, r = edges[g], edges[g + 1] - 1
    s = min(r * den // num, edges[g + 2] - 1)
    h = (den - num) * (r + s) // (den + num)
    if h == 0:
        return 0, 0, 0, 0
    best = (math.inf,)
    for p, k in [(0, 0), *((0, math.ceil(f * (h + 1))) for f in (0.25, 0.5, 1)), *((p, 0) for p in {1, (h + 1) // 2} if 1 <= p <= (h + 1) // 2)]:
        m = h + 1 + k - p
        fill = small / m

        def met(share: float, m: int = m, p: int = p, k: int = k, fill: float = fill) -> float:
            return (m - p - k) * share ** (fill * (2 if k else 1)) + p * (1 + fill) * share ** max(0.0, fill - 1)

        # left-out subsets take those of a common passage first, if there are enough of them
        passage = 0 if k >= 1.5 * m * 0.5**fill else COMMON**2 * met(0.5)
        best = min(best, (documents * (m + p * fill) + documents**2 * (met(CHANCE) + passage), m, p, k))
    return *best[1:], h


def _sets(texts: pa.Array, words: int):
    h, off = X.words(texts)
    return X.distinct(*X.shingles(h, off, words))


def _classes(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, by sums over its members, so order doesn't matter; empty sets get 0."""
    pad = lambda v: np.concatenate([[X.U(0)], np.cumsum(v, dtype=X.U)])
    a, b = pad(X.mix(x)), pad(X.mix(x ^ X.GOLD))
    return X.mix(a[off[1:]] - a[off[:-1]]), b[off[1:]] - b[off[:-1]]


def signatures(x: np.ndarray, off: np.ndarray, edges: np.ndarray, plan: np.ndarray) -> tuple[np.ndarray, ...]:
    """(signature, document, cell, segment) of all subsets and deletions. plan: a row (m, p, K, H) for each group. A cell is a
    document in a group, twice the document's place plus 0 or 1; of its subsets K may be left out. A deletion's segment is -1."""
    n = np.diff(off)
    band = np.searchsorted(edges, n, "right") - 1
    sums = X.mix(x * X.MUL1 + X.U(5))
    sigs, cells, segments = [np.zeros(0, X.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in (0, 1):
        sel = np.flatnonzero((n > 0) & (band >= back))
        sel = sel[plan[band[sel] - back, 0] > 0]
        if not len(sel):
            continue
        g = band[sel] - back
        m, p = plan[g, :2].T
        salt = X.mix(g.astype(X.U) * X.GOLD + X.U(11))
        owner = np.repeat(np.arange(len(sel)), n[sel])
        at = np.repeat(off[sel] - np.concatenate([[0], np.cumsum(n[sel])[:-1]]), n[sel]) + np.arange(len(owner))
        seg = (X.mix(x[at] + salt[owner]) % m.astype(X.U)[owner]).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(m)])
        cell = base[owner] + seg
        part = sums[at]
        total = np.bincount(cell, (part >> X.U(32)).astype(np.float64), base[-1]).astype(X.U) << X.U(32)
        total += np.bincount(cell, (part & X.U(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(X.U)
        of = np.repeat(np.arange(len(sel)), m)
        index = np.arange(base[-1]) - base[of]
        tag = X.mix(index.astype(X.U) * X.MUL2 + salt[of])
        sigs.append(X.mix(total ^ tag))
        cells.append(2 * sel[of] + back)
        segments.append(index)
        more = np.flatnonzero(seg < p[owner])
        if len(more):
            c = cell[more]
            sigs.append(X.mix((total[c] - part[more]) ^ tag[c]))
            cells.append(2 * sel[owner[more]] + back)
            segments.append(np.full(len(more), -1))
    cell = np.concatenate(cells)
    return np.concatenate(sigs), cell // 2, cell, np.concatenate(segments)


def without_commonest(sig: np.ndarray, cell: np.ndarray, count: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Which signatures stay when each cell leaves out its `leave` commonest, ties by value: one order for all sets."""
    order = np.lexsort((sig, -count, cell))
    c = cell[order]
    first = np.searchsorted(c, c)
    keep = np.ones(len(sig), bool)
    keep[order[np.arange(len(c)) - first < leave[c]]] = False
    return keep


def _shard(sig: np.ndarray, shards: int) -> np.ndarray:
    return ((sig >> X.U(40)) % X.U(shards)).astype(np.int32)


def fingerprint(cls: np.ndarray) -> int:
    """Of a batch's sets in their order."""
    return int(np.bitwise_xor.reduce(X.mix(cls + np.arange(len(cls), dtype=X.U) * X.GOLD), initial=X.U(len(cls))).view(np.int64))


def _signature_rows(words: int, edges, plan, shards: int):
    def f(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, b in enumerate(X.pieces(batches, most=3 << 20)):
            x, off = _sets(b.column("text"), words)
            cls, _ = _classes(x, off)
            mark = fingerprint(cls)
            _, first = np.unique(cls, return_index=True)
            once = np.zeros(len(cls), bool)
            once[first] = True
            sig, doc, _, _ = signatures(x, off, edges, plan)
            ok = once[doc]
            sig, c = sig[ok], cls[doc[ok]]
            order = np.lexsort((c, sig))
            sig, c = sig[order], c[order]
            # of one batch a signature's least and greatest set are enough to tell whether sets differ
            edge = np.ones(len(sig) + 1, bool)
            edge[1:-1] = sig[1:] != sig[:-1]
            keep = edge[:-1] | edge[1:]
            sig, c = sig[keep], c[keep]
            for out in S.blocks(_shard(sig, shards), sig, c):
                every = [pa.array(np.full(out.num_rows, v, kind)) for v, kind in ((task, np.int32), (k, np.int32), (mark, np.int64))]
                yield pa.RecordBatch.from_arrays([*out.columns, *every], [*out.schema.names, "task", "batch", "print"])

    return f


def _shared(uri: str):
    """Of a shard, the signatures that two different sets have and how common they are (at most two counts from each batch): kept as
    arrays, and sent back to the batches that have them."""

    def f(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        sig, cls = S.unblock(table, X.U, np.int64)
        order = np.argsort(sig)
        by, c = sig[order], cls[order]
        first = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        more = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        key, n = by[first][more], np.diff(np.append(first, len(by)))[more].astype(np.uint32)
        shard = table.column("shard")[0].as_py()
        S.put(f"{uri}/{shard}-key.npy", key)
        S.put(f"{uri}/{shard}-n.npy", n)
        ends = np.cumsum(table.column("n").to_numpy())
        place = {c: table.column(c).to_pylist() for c in ("task", "batch", "print")}
        for i, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
            mine = np.unique(sig[a:b])
            at = S.find(key, mine)
            mine, at = mine[at >= 0], at[at >= 0]
            one = next(S.blocks(np.zeros(len(mine), np.int32), mine, n[at], rising=True)) if len(mine) else None
            # a batch hears from each of its shards, so that no answer is told from a lost one
            yield pa.RecordBatch.from_pydict({"task": pa.array([place["task"][i]], pa.int32()), "batch": pa.array([place["batch"][i]], pa.int32()), "print": pa.array([place["print"][i]], pa.int64()), "n": pa.array([len(mine)], pa.int32()), "block": pa.array([one.column("block")[0].as_py() if one else b""], pa.binary())})

    return f


def _answers(uri: str):
    """All that the shards sent to the batches of a task, in one file for each task: signatures in order by batch."""

    def f(batches):
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        for task in pc.unique(table.column("task")).to_pylist():
            mine = table.filter(pc.equal(table.column("task"), task))
            sig, n = S.unblock(mine, X.U, np.uint32, rising=True)
            of = np.repeat(mine.column("batch").to_numpy(), mine.column("n").to_numpy())
            order = np.lexsort((sig, of))
            prints = np.unique(np.stack([mine.column("batch").to_numpy().astype(np.int64), mine.column("print").to_numpy()], 1), axis=0)
            for name, a in (("batch", of[order]), ("sig", sig[order]), ("n", n[order]), ("print", prints)):
                S.put(f"{uri}/{task}-{name}.npy", a)
        yield pa.RecordBatch.from_arrays([pa.array([table.num_rows])], ["n"])

    return f


def _counts(uri: str, shards: int, task: int, batch: int, mark: int, sig: np.ndarray) -> np.ndarray:
    """How common each signature is, 0 for those of one set. From the answers to this batch; if the rows were dealt otherwise
    before, so that the answers are another batch's, from the shards themselves."""
    out = np.zeros(len(sig), np.int64)
    prints = S.get(f"{uri}/{task}-print.npy", np.zeros((0, 2), np.int64))
    if ((prints[:, 0] == batch) & (prints[:, 1] == mark)).any():
        a, b = np.searchsorted(S.get(f"{uri}/{task}-batch.npy"), [batch, batch + 1])
        at = S.find(S.get(f"{uri}/{task}-sig.npy")[a:b], sig)
        return np.where(at < 0, out, S.get(f"{uri}/{task}-n.npy")[a:b][at]) if b > a else out
    of = _shard(sig, shards)
    for s in np.unique(of).tolist():
        mine = np.flatnonzero(of == s)
        key = S.get(f"{uri}/{s}-key.npy", np.zeros(0, X.U))
        at = S.find(key, sig[mine])
        out[mine] = np.where(at < 0, 0, S.get(f"{uri}/{s}-n.npy")[at]) if len(key) else 0
    return out


def _active_rows(words: int, edges, plan, answers: str, shards: int, uri: str, keep: list[str]):
    """Each document's class, size, and if some signature is shared its place in the set files and those signatures."""

    def f(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for k, b in enumerate(X.pieces(batches, most=3 << 20)):
            x, off = _sets(b.column("text"), words)
            c1, c2 = _classes(x, off)
            n = np.diff(off)
            _, first = np.unique(np.stack([c1, c2], 1), axis=0, return_index=True)
            once = np.zeros(len(c1), bool)
            once[first] = True
            sig, doc, cell, segment = signatures(x, off, edges, plan)
            ok = once[doc]
            sig, doc, cell, segment = sig[ok], doc[ok], cell[ok], segment[ok]
            count = _counts(answers, shards, pid, k, fingerprint(c1), sig)
            band = np.searchsorted(edges, n, "right") - 1
            group = plan[np.maximum(np.repeat(band, 2) - np.tile([0, 1], len(n)), 0)]
            hit = without_commonest(sig, cell, count, group[:, 2]) & (count > 0)
            # a subset that no other set has differs in every other set: bits of these segments bound the difference
            own = np.zeros((2 * len(n), WORDS), X.U)
            alone = (count == 0) & (segment >= 0) & (group[cell, 1] == 0)
            bit = segment[alone] % (64 * WORDS)
            np.bitwise_or.at(own, (cell[alone], bit // 64), X.U(1) << (bit % 64).astype(X.U))
            sig, doc, cell = sig[hit], doc[hit], cell[hit]
            order = np.argsort(cell, kind="stable")
            sig, doc, cell = sig[order], doc[order], cell[order]
            active = np.unique(doc)
            place = np.full(b.num_rows, -1, np.int64)
            if len(active):
                place[active] = (pid << 40) + (k << 20) + np.arange(len(active))
                S.put(f"{uri}/{pid}-{k}-set.npy", np.concatenate([x[off[d] : off[d + 1]] for d in active]))
                S.put(f"{uri}/{pid}-{k}-off.npy", np.concatenate([[0], np.cumsum(n[active])]))
            cls = np.stack([c1, c2], 1).astype(X.U)
            cls = pa.array([r.tobytes() if m else None for r, m in zip(cls, n, strict=True)], pa.binary())
            ends = np.searchsorted(cell, np.arange(2 * b.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sig.view(np.int64)))
            one = pa.StructArray.from_arrays([lists, pa.array(group[:, 3].astype(np.int32)), *(pa.array(own[:, i].view(np.int64)) for i in range(WORDS))], ["sigs", "h", *BITS])
            sketch = np.zeros((b.num_rows, SKETCH), X.U)
            for d in active:
                bit = np.unique(x[off[d] : off[d + 1]] % X.U(64 * SKETCH)).astype(np.int64)
                sketch[d] = np.packbits(np.bincount(bit, minlength=64 * SKETCH).astype(bool)).view(X.U)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * SKETCH), pa.array(sketch.view(np.int64).ravel()))
            full = np.flatnonzero(np.diff(ends) > 0)  # cells with a signature
            cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(full // 2, np.arange(b.num_rows + 1)).astype(np.int32)), one.take(pa.array(full)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), cls, pa.array(n), pa.array(place, mask=place < 0), cells, sketch], [*keep, "cls", "n_shingles", "place", "cells", "sketch"])

    return f


def _verify(uri: str, num: int, den: int):
    """Pairs of places whose sets are similar enough."""

    def one(place: int):
        pid, k, i = place >> 40, (place >> 20) & 0xFFFFF, place & 0xFFFFF
        o = S.get(f"{uri}/{pid}-{k}-off.npy")
        return S.get(f"{uri}/{pid}-{k}-set.npy")[o[i] : o[i + 1]]

    def f(batches):
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            ok = np.zeros(len(a), bool)
            last, x = None, None
            for j in np.argsort(a, kind="stable"):
                if a[j] != last:
                    last, x = a[j], np.array(one(int(a[j])))
                y = one(int(c[j]))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if den * len(small) < num * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                ok[j] = den * both >= num * (len(small) + len(large) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], ["a", "b"])

    return f


def classes(docs: DataFrame, *, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs(doc_id, text, ...) with n_shingles and component_id: the least doc_id that links of num/den similarity reach."""
    spark: SparkSession = docs.sparkSession
    home = S.workspace(spark, "jaccard")
    # about the words of each document, for the cost model and the number of shards
    about = F.coalesce(F.length("text"), F.lit(0)) / 6 + 1
    rows = docs.groupBy(F.floor(F.log(about) / math.log(den / num)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(about).alias("w"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("l")).collect()
    edges = bands(num, den, max((r.l for r in rows), default=0) + 1)
    near = {r.b: r.n for r in rows}
    plan = np.array([allocation(edges, g, num, den, 1 + sum(near.get(int(math.log(edges[g]) / math.log(den / num)) + d, 0) for d in (-1, 0, 1, 2))) for g in range(len(edges) - 2)], np.int64)
    shards = max(1, round(sum(r.w for r in rows) * 3.2 * (den - num) / (den + num) / SIGNATURES_PER_SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = np.array(edges)
    text = docs.select(F.col("text").cast("string").alias("text"))
    shared = f"{home}/shared"
    dealt = text.mapInArrow(_signature_rows(words, edges, plan, shards), BATCH_BLOCKS).repartitionById(shards, "shard")
    sent = dealt.mapInArrow(_shared(shared), "task int, batch int, print long, n int, block binary")
    sent.repartition(shards, "task").mapInArrow(_answers(shared), "n long").agg(F.sum("n")).collect()
    mine = ("n_shingles", "component_id", "cls", "place", "cells", "sketch", "text")
    keep = [c for c in docs.columns if c not in mine]
    cell = T.StructType([T.StructField("sigs", T.ArrayType(T.LongType())), T.StructField("h", T.IntegerType()), *(T.StructField(u, T.LongType()) for u in BITS)])
    schema = T.StructType([docs.schema[c] for c in keep] + T.StructType().add("cls", "binary").add("n_shingles", "long").add("place", "long").add("cells", T.ArrayType(cell)).add("sketch", T.ArrayType(T.LongType())).fields)
    sets = f"{home}/sets"
    found = S.saved(docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(_active_rows(words, edges, plan, shared, shards, sets, keep), schema), f"{home}/found")
    one = found.where("place is not null").groupBy("cls").agg(F.min("place").alias("v"))
    cells = found.where("place is not null").select("cls", "place", "n_shingles", "cells").join(one, "cls").where("place = v").select("v", F.col("n_shingles").alias("n"), F.explode("cells").alias("c"))
    index = S.saved(cells.select("v", "n", "c.h", *(f"c.{u}" for u in BITS), F.explode("c.sigs").alias("sig")), f"{home}/index")
    other_bits = [f"w{i}" for i in range(WORDS)]
    fits = f"{den} * least(n, m) >= {num} * greatest(n, m) AND h >= " + " + ".join(f"bit_count({u} | {w})" for u, w in zip(BITS, other_bits, strict=True))
    # the set with the fewest subsets of its own is the nearest to the middle of its group
    alone = F.expr(" + ".join(f"bit_count({u})" for u in BITS))
    pivot = index.groupBy("sig").agg(F.min(F.struct(alone.alias("alone"), F.col("v").alias("w"), F.col("n").alias("m"), *(F.col(u).alias(w) for u, w in zip(BITS, other_bits, strict=True)))).alias("p")).select("sig", "p.*")
    stars = S.saved(index.join(pivot, "sig").where(f"v <> w AND {fits}").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct(), f"{home}/stars")
    check = _verify(sets, num, den)
    links = S.saved(stars.mapInArrow(check, "a long, b long"), f"{home}/links")
    roots = components(links, f"{home}/first")
    labelled = index.join(roots, F.col("v") == F.col("node"), "left").select("sig", "v", "n", F.coalesce("root", "v").alias("root"))
    split = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    sketches = found.where("place is not null").select(F.col("place").alias("v"), *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)))
    rest = S.saved(labelled.join(split, "sig", "left_semi").join(sketches, "v"), f"{home}/rest")
    other = rest.select("sig", F.col("v").alias("w"), F.col("n").alias("m"), F.col("root").alias("other"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(SKETCH)))
    near = f"v < w AND root <> other AND {den} * least(n, m) >= {num} * greatest(n, m) AND {den + num} * ({' + '.join(f'bit_count(s{i} ^ t{i})' for i in range(SKETCH))}) <= {den - num} * (n + m)"
    pairs = rest.join(other, "sig").where(near).select(F.col("v").alias("a"), F.col("w").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = S.saved(pairs.mapInArrow(check, "a long, b long"), f"{home}/more")
    if not more.isEmpty():
        roots = components(links.unionByName(more), f"{home}/second")
    by_class = one.join(roots, F.col("v") == F.col("node"), "left").select("cls", F.coalesce("root", "v").alias("root"))
    ids = found.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = ids.join(by_class, "cls", "left").select("cls", "least", "root")
    lead = named.where("root is not null").groupBy("root").agg(F.min("least").alias("lead"))
    named = S.saved(named.join(lead, "root", "left").select(F.col("cls").alias("class"), F.coalesce("lead", "least").alias("lead")), f"{home}/named")
    return found.join(named, F.col("cls") == F.col("class"), "left").select(*keep, "n_shingles", F.coalesce("lead", "doc_id").alias("component_id"))
