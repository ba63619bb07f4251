"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import ConfigError

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a session on one machine names none, a temporary folder made once in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="veilspark-")
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below it that no other run has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
