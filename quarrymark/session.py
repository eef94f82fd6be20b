"""Session helpers: a tuned local builder and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrymark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows hold whole texts here, so batches for Python workers are bounded well below Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per context, and bound their batches where the session doesn't."""
    chosen = dict(spark.sparkContext.getConf().getAll())
    for key, value in BATCHES.items():
        if key not in chosen:
            spark.conf.set(key, value)
    context = spark.sparkContext
    if getattr(context, "_quarrymark_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrymark-zip-")
    target = Path(folder) / "quarrymark_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, Path(package.name) / path.relative_to(package))
    context.addPyFile(str(target))
    atexit.register(lambda: (target.unlink(missing_ok=True), os.rmdir(folder)) if target.exists() else None)
    context._quarrymark_shipped = True
    return spark
