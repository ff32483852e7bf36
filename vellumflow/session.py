"""Session factory: UTC, adaptive execution, shuffle partitions sized to the cores at hand."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | str | None = None, app: str = "vellumflow", **conf) -> SparkSession:
    """A local session for tests and benches; on a cluster, spark-submit sets master and memory."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
