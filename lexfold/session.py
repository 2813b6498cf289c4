"""Session construction for local runs, tests and benchmarks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, app: str = "lexfold", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, ANSI left on)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver has it.

    On a cluster the package is shipped with --py-files or installed; the added path is then without effect.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
