"""Session plumbing: the folder that driver and executors share, and this package's code on every executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="chronoloom-ship-")  # on the driver alone; Spark hands the file out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset (tests), removed when the driver ends."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        folder = tempfile.mkdtemp(prefix="chronoloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(f"file://{folder}")
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one."""
    return f"{shared_dir(spark)}/chronoloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
