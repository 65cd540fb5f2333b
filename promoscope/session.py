"""Session construction (tests, bench) and the shared scratch location.

Materialised tables (the cleaned survey table, the additive rollup, CSV
exports) are written below ``spark.checkpoint.dir`` - the shared folder the
cluster names.  Only in local mode may it be missing: then a fresh local
directory is created and registered as the checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "promoscope") -> SparkSession:
    """A local session configured like the tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        # HotSpot does not JIT methods above 8000 bytecodes; larger fused stages
        # fall back to per-operator code instead of running interpreted.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # no Python call-site capture on every Column call (error context only)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PROMOSCOPE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint dir; a fresh local one only when unset."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="promoscope-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/promoscope/{name}-{uuid.uuid4().hex[:12]}"



def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package; in local mode they inherit the driver's PYTHONPATH."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    sc = spark.sparkContext
    inherited = sc.master.startswith("local") and root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if inherited or sc.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="promoscope-py-"), "promoscope.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
