"""Session builder with the settings the engine is tested under."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(cpus: str | None = None, shuffle_partitions: int | None = None, shared_dir: str | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster supplies its own."""
    n = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared_dir) if shared_dir else SparkSession.builder
    return (
        builder.master(f"local[{n}]")
        .appName("heron")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HERON_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Gives this package's modules to the executors' Python, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_heron_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="heron-ship-")) / "heron_modules.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._heron_shipped = True


def folder(spark) -> str:
    """A new folder in the shared one; only a local session (tests) may do without."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="heron-files-")
    return f"{set_to.rstrip('/')}/files-{uuid.uuid4().hex}"
