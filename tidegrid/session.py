"""Session settings for local tests and the benchmark, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(name: str, cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEGRID_DRIVER_MEMORY", "8g"))
        # call-site capture costs more than planning for wide expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()

#: Bytes of the batches that rows go to Python in, and the engine's own limit, in whose place it comes.
BATCH_BYTES, ENGINE_BATCH_BYTES = 8 << 20, 64 << 20


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of the session, once per application.

    Tasks that run Python import their functions from it, wherever the process was started.  Batches are kept
    small enough for workers with long texts, unless the session has a limit of its own.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) in (f"{ENGINE_BATCH_BYTES}b", str(ENGINE_BATCH_BYTES), "64MB", "64m"):
        spark.conf.set(limit, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tidegrid-ship-")) / "tidegrid.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
