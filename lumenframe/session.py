"""Session builder with the defaults the library's plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lumenframe", cpus: int | None = None, **extra: str) -> SparkSession:
    """A UTC session with AQE on; local mode only where no master is configured elsewhere."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER"):
        # a cluster keeps its own number of shuffle partitions
        builder = builder.master(f"local[{n}]")
        conf = {"spark.sql.shuffle.partitions": str(n)} | conf
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
