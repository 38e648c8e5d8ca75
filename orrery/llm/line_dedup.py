"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions alone.

Documents come in batches of falling doc_id. A batch's run holds, for each line key, how many of its
documents have the line and the largest of them. Merge-anti-joined with the runs so far, the keys not met
before are added with their holder, which is the largest doc_id over all, as later batches hold smaller
ones; keys met before are added as counts only. When a level has `fanout` runs they are compacted
into one sorted run of the next. The runs are Parquet in the shared folder, so any task can be repeated.

Lines that repeat in enough documents go from all but their holder. Keys that more than a 2,000th of
all entries share number at most 2,000: those are broadcast, all others are joined by a shuffle, so no
line, however common, makes an uneven task.

Nulls and edges: a null or empty text is one empty line; a null doc_id counts as smaller than any other; of
rows that share the holder's doc_id all keep the line; ids are whole numbers (a text that is none raises); each row counts as a document; hashes are of 128 bits.
An empty table gives an empty one. Incoming columns named like a result are dropped.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _store as S

SPACE = " \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
KEY = ["h1", "h2"]
#: At most so many keys are common enough to be broadcast.
COMMON = 2_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineRuns:
    """Sorted runs of (h1, h2, n, holder), by level. holder is null in a run whose key an older run holds."""

    def __init__(self, home: str, fanout: int = 2):
        self.home, self.fanout, self.levels, self.made = home, fanout, [[]], 0

    def _write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        return S.saved(df.sortWithinPartitions(*KEY), f"{self.home}/run{self.made}")

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n, holder), one row a key, of documents below those added before."""
        if self.all():
            held = reduce(DataFrame.unionByName, self.all()).where("holder is not null").select(*KEY).hint("merge")
            seen = batch.join(held, KEY, "left_semi").withColumn("holder", F.lit(None).cast("long"))
            batch = batch.join(held, KEY, "left_anti").unionByName(seen)
        self.levels[0].append(self._write(batch))
        for k, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self.merged(level)))
            self.levels[k] = []

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame:
        runs = self.all() if runs is None else runs
        if len(runs) == 1:
            return runs[0]
        return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))


def _runs(docs: DataFrame, home: str, min_chars: int, batches: int) -> LineRuns:
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    bounds = docs.select(id_.alias("id")).stat.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    batch = reduce(lambda x, b: x + (id_ < F.lit(int(b))).cast("int"), bounds, F.lit(0))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars))
    entries = docs.select(id_.alias("id"), batch.alias("batch"), F.explode(keys).alias("key")).select("id", "batch", *_hashes(F.col("key")))
    staged = f"{home}/staged"
    entries.groupBy("batch", *KEY).agg(F.count("*").alias("n"), F.max("id").alias("holder")).write.mode("overwrite").partitionBy("batch").parquet(staged)
    runs = LineRuns(f"{home}/runs")
    schema = "h1 long, h2 long, n long, holder long, batch int"
    every = docs.sparkSession.read.schema(schema).parquet(staged)
    for k in range(batches):
        runs.add(every.where(F.col("batch") == k).drop("batch"))
    return runs


def without_repeats(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """docs(doc_id, text, ...) with text without its repeated lines, n_lines (before) and n_dropped."""
    home = S.workspace(docs.sparkSession, "lines")
    runs = _runs(docs, home, min_chars, batches)
    merged = S.saved(runs.merged(), f"{home}/merged") if len(runs.all()) > 1 else runs.merged()
    hot = merged.where(F.col("n") >= min_docs)
    bound = max(min_docs, (merged.agg(F.sum("n")).first()[0] or 0) // COMMON)
    common = hot.where(F.col("n") > bound).select(*KEY, F.col("holder").alias("common_holder"))
    rare = hot.where(F.col("n") <= bound).select(*(F.col(k).alias(f"rare_{k}") for k in KEY), "holder")
    mine = ("n_lines", "n_dropped")
    kept = [c for c in docs.columns if c not in mine]
    keyed = docs.select(*kept, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"))
    long_lines = keyed.select("_id", "_text", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("_id", "_text", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars).select("_id", "_text", "pos", *_hashes(F.col("key")))
    marked = long_lines.join(F.broadcast(common), KEY, "left")
    # a line found among the common ones goes to the shuffle by its own place, where nothing matches it
    marked = marked.withColumn("k1", F.when(F.col("common_holder").isNull(), F.col("h1")).otherwise(F.xxhash64("_id", "_text", "pos")))
    found = marked.join(rare, (F.col("k1") == F.col("rare_h1")) & (F.col("h2") == F.col("rare_h2")), "left")
    gone = found.where(F.coalesce("common_holder", "holder") != F.col("_id")).groupBy("_id", "_text").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    out = keyed.join(gone, ["_id", "_text"], "left")
    before = F.concat(F.array(F.lit(-1)), F.slice("gone", 1, F.size("gone") - 1))
    # true at each dropped line: the gaps between dropped lines, each followed by one true
    flags = F.flatten(F.transform(F.zip_with("gone", before, lambda a, b: a - b - 1), lambda gap: F.concat(F.array_repeat(F.lit(False), gap), F.array(F.lit(True)))))
    pairs = F.zip_with(_lines(F.col("text")), flags, lambda line, drop: F.struct(line.alias("line"), F.coalesce(drop, F.lit(False)).alias("drop")))
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(F.filter(pairs, lambda p: ~p["drop"]), lambda p: p["line"]), "\n"))
    return out.select(*(text.alias(c) if c == "text" else c for c in kept), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
