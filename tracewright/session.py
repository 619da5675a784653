"""Sessions, and the package's own code on the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session as the tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tracewright")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors unless their Python path already has it."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = any(p and (Path(p) / root.name / "session.py").exists() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or app in _SHIPPED:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), root.name), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)  # fetched from the driver as long as the session lives
    _SHIPPED.add(app)
