"""Session settings, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(name: str = "featlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; conf keys have dots written as double underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_importable(spark: SparkSession) -> None:
    """Python workers import this package by name. Where neither PYTHONPATH nor the working folder has it, it is sent as a zip file."""
    root = str(_PACKAGE.parent)
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.isdir(_PACKAGE.name):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="featlab-"), "featlab.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
