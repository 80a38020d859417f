"""A place for tables that the driver and all executors can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``. Only a session on this machine alone may lack that setting; it gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        root = tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/loomspan/{uuid.uuid4().hex}"
