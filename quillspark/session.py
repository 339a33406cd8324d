"""Session construction for local runs; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session with UTC timestamps and adaptive execution."""
    cpus = cpus or os.cpu_count() or 2
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillspark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
