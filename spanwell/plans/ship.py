"""The package for executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def archive(folder: Path) -> str:
    """A zip file of the package, for ``addPyFile``."""
    path = Path(tempfile.mkdtemp(prefix="spanwell-ship-")) / "spanwell.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(folder.rglob("*.py")):
            z.write(f, f.relative_to(folder.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once an application; workers of local mode share the driver's own path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    if context.master.startswith("local"):
        # workers are started by the driver, wherever that was started
        context.environment["PYTHONPATH"] = f"{root.parent}:{context.environment.get('PYTHONPATH', '')}"
    else:
        context.addPyFile(archive(root))
