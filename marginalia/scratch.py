"""Tables written to the shared folder of ``spark.checkpoint.dir``, to cut lineage between rounds and to make once what is used often."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

from marginalia.session import ship


def saved(df: DataFrame) -> DataFrame:
    """``df``, written once and read again. Only a session within one process may leave the setting unset, and gets a temporary folder."""
    spark = df.sparkSession
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
