"""Session construction for local runs and tests; clusters bring their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "millrace", cpus: int | str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that every result here assumes: UTC and AQE."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
