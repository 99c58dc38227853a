"""Send the package to the executors' Python workers (``--py-files`` at run time)."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Zip this package and add it to the session's Python path once per
    application, so that functions pickled by reference can be imported there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="corpusflow-pyfiles-"), "corpusflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _dirs, files in os.walk(_ROOT):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
