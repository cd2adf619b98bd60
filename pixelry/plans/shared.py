"""The folder that driver and executors share, for tables between rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder in local mode and an error on a cluster."""
    try:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    except PySparkException:
        found = None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
