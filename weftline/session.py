"""Session defaults; nothing happens on import."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "weftline", cpus: int | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitted configuration holds.

    conf: more settings, with __ for dots.
    """
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_importable(spark: SparkSession) -> None:
    """Python workers find this package where it is, however the driver found it.

    That serves local sessions and shared installs; on other clusters submit it with --py-files.
    """
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    path = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in path:
        env["PYTHONPATH"] = os.pathsep.join([*path, root])
