"""Guarded tables: DataFrames registered under a name that the policy knows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError

READERS = ("parquet", "orc", "csv", "json", "text")


@dataclass(frozen=True)
class GuardedTable:
    """``opaque``: a view over a set operation, whose columns have no single source."""

    name: str
    frame: DataFrame
    opaque: bool = False
    columns: tuple[str, ...] = field(default=())


def read(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    if format not in READERS:
        raise ConfigError(f"no reader for {format!r}")
    return spark.read.format(format).options(**options).load(path)


def register(frame: DataFrame, name: str, opaque: bool = False) -> GuardedTable:
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", name):
        raise ConfigError(f"{name!r} is not a table name (table, or schema.table)")
    name = name.lower()
    frame.createOrReplaceTempView(f"`{name}`")
    return GuardedTable(name, frame, opaque, tuple(c.lower() for c in frame.columns))
