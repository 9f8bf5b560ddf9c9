"""Session defaults: everything a local run needs; on a cluster the submitted configuration wins."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="papyrine_")
        shared = _LOCAL["dir"]
    return f"{shared.rstrip('/')}/{name}_{uuid.uuid4().hex}"


def local_session(cpus: int | None = None, name: str = "papyrine") -> SparkSession:
    """A local session for tests and the bench. Nothing here is read on a cluster."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
