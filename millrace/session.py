"""Session defaults for local runs; a cluster passes its own session in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "millrace", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A local session in UTC; settings a cluster would carry in its own defaults."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the supplied tables, by Spark's own reader (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
