"""Sending the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: What a batch between the JVM and Python holds at most, unless the session says otherwise: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> SparkSession:
    """Let this context's Python workers import the package, wherever they run; once a context."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="veilspark-code-"), "veilspark_code.zip")
        with zipfile.ZipFile(out, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith((".py", ".txt", ".tsv")):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("veilspark", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(out)
        _shipped.add(app)
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    return spark
