"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "orrery", master: str | None = None, **conf: str) -> SparkSession:
    """An adaptive, UTC session; on a cluster leave master unset."""
    b = SparkSession.builder.appName(name)
    if master or not os.environ.get("SPARK_MASTER_SET"):
        b = b.master(master or "local[*]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
