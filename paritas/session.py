"""Session defaults for local runs and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app_name: str = "paritas") -> SparkSession:
    """A session for tests and benchmarks. On a cluster use the session you are given."""
    cores = str(cpus)
    partitions = cores if cores.isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@lru_cache(maxsize=1)
def _own_folder() -> tempfile.TemporaryDirectory:
    """One folder per process of a local master, removed when the process ends."""
    return tempfile.TemporaryDirectory(prefix="paritas-", ignore_cleanup_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh directory name below the shared folder in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine: the executors
    of a cluster could not read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        shared = _own_folder().name
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
