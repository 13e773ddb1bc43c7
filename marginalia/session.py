"""Session builder, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def session(app: str = "marginalia", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution and UTC time; ``conf`` keys use underscores for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), str(v))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that it need not be installed on the cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="marginalia-"), "marginalia.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.join("marginalia", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    sc._marginalia_shipped = True
