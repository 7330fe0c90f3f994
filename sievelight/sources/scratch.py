"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, in local
    mode only, below a temporary folder of this application."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='sievelight-')}"
        at = _own[app]
    elif "://" not in at and not at.startswith("file:"):
        at = f"file://{os.path.abspath(at)}"
    return f"{at.rstrip('/')}/sievelight/{name}-{uuid.uuid4().hex}"
