"""Makes the library importable in Python workers that do not share its folder."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package (and top-level modules beside it) to the executors, once per application.

    Spark serves the archive from the driver to each executor's own files.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, top))
        for n in ("corpus_pipeline.py",):
            if os.path.exists(os.path.join(top, n)):
                z.write(os.path.join(top, n), n)
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "assayforge-src.zip")
    with open(path, "wb") as f:
        f.write(raw.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
