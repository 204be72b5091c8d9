"""Making this package importable in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quire-ship-")
    _folders.append(folder)
    archive = Path(folder) / "quire_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


@atexit.register
def _clean() -> None:
    for folder in _folders:
        shutil.rmtree(folder, ignore_errors=True)
