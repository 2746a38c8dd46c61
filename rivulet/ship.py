"""Sending the package to the workers of a session that was started where they can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to all executors of the session, those that join later too; once per application. Not needed
    where the package is installed on the workers or on their PYTHONPATH."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        folder = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="rivulet-"), "rivulet.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for top, _, names in os.walk(folder):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join("rivulet", os.path.relpath(full, folder)))
        spark.sparkContext.addPyFile(path)
        _SENT.add(app)
    return spark
