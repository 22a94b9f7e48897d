"""A session with the settings that the library's results rest on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each application, as Spark does it for any job's modules."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(), f"{name}-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    out.write(full, os.path.join(name, os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def session(master: str | None = None, name: str = "tidemark", **conf: str) -> SparkSession:
    """UTC days, ANSI arithmetic and adaptive plans; everything else is the cluster's own."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
