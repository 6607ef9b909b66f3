"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession, label: str = "files") -> str:
    """A new name under spark.checkpoint.dir. Where that is unset, under a folder of this machine, but only in a local
    session: executors of a cluster would each write to their own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="quire-shared-"))
            atexit.register(shutil.rmtree, _own[0], True)
        base = "file://" + _own[0]
    return f"{base.rstrip('/')}/quire-{label}-{uuid.uuid4().hex}"
