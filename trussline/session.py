"""Session builder for local runs, tests and the benchmark."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def let_workers_import(spark: SparkSession) -> None:
    """Put the repository on the path of Python workers started from now on, for sessions that did not install it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def local_session(cpus: int | str = "*", app: str = "trussline", memory: str = "12g") -> SparkSession:
    """A local session with the settings every module here assumes: UTC, AQE, few shuffle partitions.

    On a cluster the caller brings its own session; nothing in the library depends on this builder.
    """
    os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    let_workers_import(spark)
    return spark
