"""Makes the package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession, root: str) -> None:
    """Send the package to the workers of this application, once, unless PYTHONPATH already names it."""
    app = spark.sparkContext.applicationId
    if app in _DONE or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(), "sparkloom-package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(os.path.join(root, "sparkloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.relpath(full, root))
        if os.path.exists(pipeline := os.path.join(root, "corpus_pipeline.py")):
            out.write(pipeline, "corpus_pipeline.py")
    spark.sparkContext.addPyFile(path)
    _DONE.add(app)
