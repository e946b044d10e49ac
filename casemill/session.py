"""Spark session with the settings that the plans of this package assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | str | None = None, shuffle_partitions: int | None = None, app: str = "casemill") -> SparkSession:
    """Local session for tests and benches; on a cluster the submitted session is used as it is."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CASEMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    return builder.getOrCreate()
