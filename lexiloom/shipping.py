"""Makes this package importable in the Python workers of a cluster."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Spark's own file server distributes them, so the driver needs no shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    folder = Path(tempfile.mkdtemp(prefix="lexiloom-ship-"))
    archive = folder / "lexiloom_sources.zip"
    archive.write_bytes(data.getvalue())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
