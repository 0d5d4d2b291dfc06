"""Get the package to executors that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once, unless workers
    find it by PYTHONPATH or in the working folder. Spark hands the archive to
    each executor."""
    app = spark.sparkContext.applicationId
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if app in _SHIPPED or any(Path(p).resolve() == PACKAGE.parent for p in known):
        return
    archive = Path(tempfile.mkdtemp(prefix="retrolens-")) / "retrolens.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
