"""From an access log to hot documents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GOLDEN = 0x9E3779B97F4A7C15


def newest(log: DataFrame, ts: str = "ts") -> datetime:
    """The time as of which a log is read: its last event."""
    return log.agg(F.max(ts)).first()[0]


def one_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row, such as an aggregate without keys."""
    return rows.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def recent(log: DataFrame, asof: datetime | Column, window_s: float) -> DataFrame:
    return log.where(F.unix_micros("ts") >= F.unix_micros(_when(asof)) - int(window_s * 1e6))


def _when(asof: datetime | Column) -> Column:
    return asof if isinstance(asof, Column) else F.lit(asof)


def age_s(ts: Column, asof: datetime | Column) -> Column:
    return (F.unix_micros(_when(asof)) - F.unix_micros(ts)) / 1e6


def hotness(log: DataFrame, asof: datetime | Column, window_s: float, halflife_s: float) -> DataFrame:
    """(doc_id, raw, accesses, last_ts, last_age_s): raw sums exp(-age / halflife) over the window."""
    decay = F.exp(-F.greatest(age_s(F.col("ts"), asof), F.lit(0.0)) / max(halflife_s, 1.0))
    return recent(log, asof, window_s).groupBy("doc_id").agg(F.sum(decay).alias("raw"), F.count("*").alias("accesses"), F.max("ts").alias("last_ts"), F.min(age_s(F.col("ts"), asof)).alias("last_age_s"))


def normalised(scores: DataFrame, *, boost: float = 0.12, boost_s: float = 90.0) -> DataFrame:
    """score in [0, 1] on a log scale, raised for what was just used."""
    base = F.when(F.col("_top") > 0, F.log1p("raw") / F.log1p("_top")).otherwise(0.0)
    fresh = F.col("last_age_s") <= boost_s
    return one_row(scores, scores.agg(F.max("raw").alias("_top"))).withColumn("score", F.when(fresh, F.least(F.lit(1.0), base + boost)).otherwise(base)).drop("_top")


def corrected(scores: DataFrame, feedback: DataFrame, floor: float = 0.0) -> DataFrame:
    """feedback: doc_id, fp (wrongly cached), fp_age_s, fn (wrongly left out), streak (misses in a row)."""
    s = scores.join(feedback, "doc_id", "left")
    fp, fn, streak = (F.coalesce(c, F.lit(0)) for c in ("fp", "fn", "streak"))
    fresh = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-F.coalesce("fp_age_s", F.lit(0.0)) / 60)))
    x = F.when(fp > 0, F.greatest(F.lit(floor), F.col("score") - F.least(F.lit(0.55), 0.15 * fp * (0.5 + 0.5 * fresh)))).otherwise(F.col("score"))
    x = F.when(fn > 0, F.least(F.lit(1.0), x + F.least(F.lit(0.20), 0.02 * fn))).otherwise(x)
    x = F.when(streak >= 6, F.greatest(F.lit(floor), x / (1 + 0.35 * F.least(streak, F.lit(64))))).otherwise(x)
    return s.withColumn("score", x).drop("fp", "fp_age_s", "fn", "streak")


def admission(score: Column, streak: Column) -> Column:
    return score / (1 + F.least(F.lit(1.0), 0.35 * F.least(streak, F.lit(10))))


def diverse_top(scores: DataFrame, limit: int, buckets: int = 256) -> DataFrame:
    """The best `limit` documents, at most ceil(limit / buckets) of a hash bucket as long as others are left."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    cap = -(-limit // buckets)
    bucket = F.pmod(F.pmod(F.col("doc_id"), F.lit(buckets)) * F.lit(GOLDEN % buckets), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("score").desc(), "doc_id"))
    return scores.withColumn("bucket", bucket.cast("int")).withColumn("over_cap", place > cap).orderBy("over_cap", F.col("score").desc(), "doc_id").limit(limit)


def recalibrated(scores: DataFrame, target: int, previous: float, *, floor: float = 0.05, smoothing: float = 0.2) -> DataFrame:
    """The threshold that keeps about `target` documents, moved a part of the way from the previous one."""
    last = scores.orderBy(F.col("score").desc(), "doc_id").limit(target).agg(F.min("score").alias("cut"))
    cut = F.greatest(F.lit(floor), F.least(F.lit(1.0), F.col("cut")))
    return last.select(F.coalesce((1 - smoothing) * F.lit(previous) + smoothing * cut, F.lit(previous)).alias("threshold"))


def ring_buffer(log: DataFrame, n: int, order: str) -> DataFrame:
    return log.orderBy(F.col(order).desc()).limit(n)


def diversity(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.countDistinct("doc_id") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("diversity"), F.count("*").alias("accesses"))


#: Ranges into which each group's values are cut, at approximate quantiles, to look for a place among them.
RANGES = 64


def at_places(values: DataFrame, by: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(*by, one column for each of places): the value at an index, from 0, of each group's sorted values. Nulls don't count.

    places: the index by the number of values. Equal values are counted where they are read; counts of ranges tell which
    range holds an index; only the different values of that range are ranked, so a group of any size is
    no task of its own.
    """
    rows = values.where(F.col(value).isNotNull()).select(F.struct(*by).alias("_key"), F.col(value).alias("_v"))
    bounds = rows.groupBy("_key").agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], F.lit(1_000)).alias("_bounds"), F.count("*").alias("_n"))
    counts = rows.groupBy("_key", "_v").agg(F.count("*").alias("_c"))
    cut = counts.join(bounds, "_key").withColumn("_range", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))))
    ranges = cut.groupBy("_key", "_range").agg(F.sum("_c").alias("_size"), F.max("_n").alias("_n"))
    upto = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_below", F.sum("_size").over(upto) - F.col("_size"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), at(F.col("_n")).cast("long").alias("at")) for name, at in places.items())))
    held = ranges.select("_key", "_range", "_size", "_below", wanted.alias("_w")).where("_w.at >= _below AND _w.at < _below + _size").select("_key", "_range", F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_below")).alias("_at"))
    running = F.sum("_c").over(Window.partitionBy("_key", "_name").orderBy("_v"))
    placed = cut.select("_key", "_range", "_v", "_c").join(held, ["_key", "_range"]).withColumn("_end", running).where("_at >= _end - _c AND _at < _end")
    out = placed.groupBy("_key").agg(*(F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places))
    return out.select(*(F.col(f"_key.{c}").alias(c) for c in by), *places)


def by_floor(p: float) -> Callable[[Column], Column]:
    """The index floor(p/100 * n), at most the last."""
    return lambda n: F.least(F.floor(F.lit(p / 100) * n), n - 1)


def by_round(p: float) -> Callable[[Column], Column]:
    """The index round(p/100 * (n - 1))."""
    return lambda n: F.floor(F.lit(p / 100) * (n - 1) + 0.5)


def nearest_rank(values: DataFrame, by: list[str], value: str, percents: list[float], rule: str = "floor") -> DataFrame:
    """Percentiles by index in the sorted values, by_floor or by_round; as p50, p99 and so on."""
    index = by_floor if rule == "floor" else by_round
    return at_places(values, by, value, {f"p{p:g}": index(p) for p in percents})


def predictor_stats(scores: DataFrame, threshold: float, percents: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """One row: tracked documents, those above the threshold, the mean score, and percentiles by round(p/100 * (n - 1)).

    Scores lie in [0, 1]. Counts of at most 10,001 ranges tell which ranges hold the percentiles; only the different
    scores of those are ranked.
    """
    values = scores.groupBy("score").agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col("score") * 10_000))
    ranges = values.groupBy("range").agg(F.sum("c").alias("size"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("below", F.sum("size").over(upto) - F.col("size")).withColumn("n", F.sum("size").over(Window.partitionBy()))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.floor(p / 100 * (F.col("n") - 1) + 0.5).alias("at")) for p in percents)))
    held = ranges.select("range", "size", "below", wanted.alias("w")).where("w.at >= below AND w.at < below + size").select("range", "w.p", (F.col("w.at") - F.col("below")).alias("at"))
    running = F.sum("c").over(Window.partitionBy("p").orderBy("score"))
    placed = values.join(F.broadcast(held), "range").withColumn("end", running).where("at >= end - c AND at < end")  # one row of held to each percentile
    points = placed.agg(*(F.max(F.when(F.col("p") == p, F.col("score"))).alias(f"p{p}") for p in percents))
    whole = scores.agg(F.count("*").alias("tracked"), F.count_if(F.col("score") > threshold).alias("hot"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))
    return whole.withColumn("_one", F.lit(1)).join(points.withColumn("_one", F.lit(1)), "_one").drop("_one")


def confusion(predictions: DataFrame) -> DataFrame:
    """predictions: predicted, actual (booleans): how many of each combination."""
    hit = lambda p, a: F.count_if((F.col("predicted") == p) & (F.col("actual") == a))
    return predictions.agg(hit(True, True).alias("tp"), hit(True, False).alias("fp"), hit(False, True).alias("fn"), hit(False, False).alias("tn"))


def training_cycles(log: DataFrame, every_s: int, window_s: int, least: int) -> DataFrame:
    """(cycle, events, trained): a cycle every `every_s` after the log's first event sees its last `window_s`, and trains on `least` events or more."""
    t = F.unix_micros("ts")
    every, window = every_s * 1_000_000, window_s * 1_000_000
    start, end = log.agg(F.min(t), F.max(t)).first()
    spark = log.sparkSession
    if start is None or end - start < every:
        return spark.createDataFrame([], "cycle long, events long, trained boolean")
    last = (end - start) // every
    since = t - F.lit(start)
    first = F.greatest(F.lit(1), F.ceil(since / every)).cast("long")
    seen = F.least(F.lit(last), F.floor((since + window) / every)).cast("long")
    counts = log.select(first.alias("a"), seen.alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("cycle")).groupBy("cycle").agg(F.count("*").alias("events"))
    n = F.coalesce("events", F.lit(0))
    return spark.range(1, last + 1).select(F.col("id").alias("cycle")).join(counts, "cycle", "left").select("cycle", n.alias("events"), (n >= least).alias("trained"))
