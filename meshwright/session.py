"""Session defaults used by tests and the benchmark; a cluster brings its own."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "meshwright", partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
