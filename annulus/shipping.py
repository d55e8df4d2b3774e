"""Make this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="annulus-src-")), "annulus.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in sorted(os.walk(_HERE)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(top, name)
                z.write(full, os.path.join("annulus", os.path.relpath(full, _HERE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
