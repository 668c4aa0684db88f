"""A PySpark-native engine for listing documents and training text."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile


def ship(spark) -> str:
    """Send this package to the executors, where it is not installed there: Python workers import it from a zip file that
    the driver serves. Returns the file's path on the driver."""
    here = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("siltstone", os.path.relpath(path, here)))
    path = os.path.join(tempfile.mkdtemp(prefix="siltstone-ship-"), "siltstone.zip")
    with open(path, "wb") as out:
        out.write(body.getvalue())
    spark.sparkContext.addPyFile(path)
    return path
