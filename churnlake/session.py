"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "churnlake") -> SparkSession:
    """Local session used by tests and the bench.

    On a cluster the session comes from the launcher; these settings only
    describe what the library expects: UTC, AQE on, no UI.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHURNLAKE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )


_FALLBACK_DIRS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint folder).
    Only when neither is configured and the master is ``local`` (one
    machine) do we create a scratch folder and register it as the context's
    checkpoint folder. On a cluster it would be another folder on every
    machine, so a session without a shared folder is refused there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        ck = sc.getCheckpointDir()
        if ck:
            path = ck.rsplit("/", 1)[0]  # the context adds a per-application subfolder
        else:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            path = _FALLBACK_DIRS.get(id(sc)) or tempfile.mkdtemp(prefix="churnlake-")
            _FALLBACK_DIRS[id(sc)] = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused location under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/churnlake/{name}/{uuid.uuid4().hex}"
