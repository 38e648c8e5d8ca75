"""Streams of accesses: windowed counts, running hotness, and searches by micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.knn import knn


def windowed_counts(log: DataFrame, width: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """log: ts, doc_id; batch or stream. Accesses of each document in sliding windows.

    A batch is counted by slide first; only the counts are expanded to the windows that hold them.
    """
    wide, step = pd.Timedelta(width), pd.Timedelta(slide)
    if not log.isStreaming and wide % step == pd.Timedelta(0):
        parts = log.groupBy(F.window("ts", slide).alias("w"), "doc_id").agg(F.count("*").alias("n"))
        starts = F.expr(f"sequence(w.start - INTERVAL '{(wide - step).total_seconds():.6f}' SECOND, w.start, INTERVAL '{step.total_seconds():.6f}' SECOND)")
        out = parts.select("doc_id", "n", F.explode(starts).alias("start")).groupBy("start", "doc_id").agg(F.sum("n").alias("accesses"))
        return out.select("start", (F.col("start") + F.expr(f"INTERVAL '{wide.total_seconds():.6f}' SECOND")).alias("end"), "doc_id", "accesses")
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "doc_id").agg(F.count("*").alias("accesses")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "doc_id", "accesses")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "doc_id").agg(F.count("*").alias("accesses")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "doc_id", "accesses")


def running_hotness(log: DataFrame, halflife_s: float) -> DataFrame:
    """A decayed sum for each document, kept as state (sum, time of it): exact, as decay over two spans is their product."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, at = state.get if state.exists else (0.0, None)
        for pdf in batches:
            for t in sorted(pdf["ts"].astype("int64") / (1e9 if pdf["ts"].dtype == "datetime64[ns]" else 1e6)):
                if at is None or t >= at:
                    total, at = total * (0.0 if at is None else float(2.718281828459045 ** (-(t - at) / halflife_s))) + 1.0, t
                else:  # late: it has decayed by now
                    total += float(2.718281828459045 ** (-(at - t) / halflife_s))
        state.update((total, at))
        yield pd.DataFrame({"doc_id": [key[0]], "hotness": [total], "asof_s": [at]})

    return log.select("doc_id", "ts").groupBy("doc_id").applyInPandasWithState(update, "doc_id long, hotness double, asof_s double", "total double, at double", "update", GroupStateTimeout.NoTimeout)


def bulk_search(queries: DataFrame, corpus: DataFrame, k: int, sink, metric: str = "cosine"):
    """Searches each micro-batch of a stream of (query_id, embedding); sink(results, batch_id) stores them."""

    def one(batch: DataFrame, batch_id: int) -> None:
        sink(knn(corpus, batch, k, metric), batch_id)

    return queries.writeStream.foreachBatch(one)
