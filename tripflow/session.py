"""Session settings used by the tests and the bench; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "tripflow", cpus: int | None = None) -> SparkSession:
    """A local session with one shuffle partition per core."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
