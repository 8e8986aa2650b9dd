"""Bring Python modules to the workers, for the few steps that run Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path
from types import ModuleType

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, package: ModuleType) -> None:
    """Send the sources of a package to the executors, once per application."""
    context = spark.sparkContext
    mark = (context.applicationId, package.__name__)
    if mark in _shipped:
        return
    folder = Path(package.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.__name__}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(folder.rglob("*.py")):
            archive.write(source, source.relative_to(folder.parent))
    # The driver serves the file to every executor, also to later ones.
    context.addPyFile(str(target))
    _shipped.add(mark)
