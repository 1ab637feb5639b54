"""The package on the executors: sent once a context, so that Python workers find it wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def on_executors(spark: SparkSession) -> None:
    """Send the package with the next task, once a context. The archive is read by the driver's file server only."""
    context = spark.sparkContext
    if getattr(context, "_cytofold_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="cytofold-")) / "cytofold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(archive))
    context._cytofold_sent = True
