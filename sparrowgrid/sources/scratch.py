"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, deleted when the application ends. Where that is
    unset, in a temporary folder, but only for a local master: a cluster's executors wouldn't see it, so there it raises.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='sparrowgrid-')}"
    path = f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
