"""Send the package to the executors, for sessions started without it on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip file to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="quernstone-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    # streams with state start a Python process on the driver that knows no Python files but those on its path
    environment = spark.sparkContext.environment
    environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), str(path)]))
    _sent.add(app)
