"""What a session needs before queries run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a session, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="eventlake-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        staged = os.path.join(folder, "package")
        shutil.copytree(package, os.path.join(staged, package.name), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "eventlake-package"), "zip", staged))
        # Stream sources are planned by a Python process beside the driver, which gets no shipped files.
        paths = [str(package.parent), *filter(None, [spark.sparkContext.environment.get("PYTHONPATH")])]
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(paths)
        _SHIPPED.add(app)
    return spark
