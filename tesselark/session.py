"""A SparkSession with the settings the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tesselark", cpus: int | None = None, **conf) -> SparkSession:
    """UTC, adaptive execution, and as many shuffle partitions as cores unless told otherwise. On a cluster, pass
    spark.sql.shuffle.partitions by the data's size; adaptive execution merges what is too small. Checkpoints go when nothing refers to them any more."""
    n = cpus or os.cpu_count() or 8
    b = SparkSession.builder.appName(app)
    base = {
        "spark.master": f"local[{n}]",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
