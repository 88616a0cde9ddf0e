"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that isn't set, a temporary one if all runs in one process; else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{top or tempfile.mkdtemp(prefix='reelspark-')}/{name}-{uuid.uuid4().hex}"
