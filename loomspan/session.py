"""Session construction and table access."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build_session(app: str = "loomspan", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine's semantics rely on: UTC, ANSI arithmetic, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def test_session() -> SparkSession:
    """The session of tests and benchmarks on one machine."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    return build_session("loomspan-local", f"local[{cpus}]", 8, **{"spark.driver.memory": "8g"})


def shared_folder(spark: SparkSession) -> str:
    """Where every executor can write: spark.checkpoint.dir, or the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
