"""Makes this package importable on executors, whatever their working directory."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))


def ship_package(spark: SparkSession) -> SparkSession:
    """Give executors a zip of the package, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillspark_shipped", False):
        return spark
    folder = os.path.realpath(tempfile.mkdtemp(prefix="quillspark-"))
    target = os.path.join(folder, "quillspark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for base, _, names in os.walk(_ROOT):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    out.write(full, os.path.join("quillspark", os.path.relpath(full, _ROOT)))
    sc.addPyFile(target)
    sc._quillspark_shipped = True
    return spark
