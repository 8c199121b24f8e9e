"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join splitting switched on.

    Cluster settings (memory, executors, ``spark.checkpoint.dir``) are left to
    the submitter; ``conf`` overrides anything set here.
    """
    builder = SparkSession.builder.appName("passagework")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # passages differ in size: bound Arrow batches by bytes as well as by rows
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may start in any folder."""
    root = os.path.dirname(os.path.abspath(__file__))
    held = tempfile.mkdtemp(prefix="passagework-ship-")  # the driver serves the file from here
    archive = os.path.join(held, "passagework.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
