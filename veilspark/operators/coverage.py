"""What a schema change did to the columns that rules name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "relation string, column_name string, position int, data_type string"


def snapshot(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(r.lower(), f.name.lower(), i, f.dataType.simpleString()) for r, d in sorted(tables.items()) for i, f in enumerate(d.schema)]
    return spark.createDataFrame(rows, SNAPSHOT)


def coverage_diff(old: DataFrame, new: DataFrame, rules: DataFrame) -> DataFrame:
    """relation, column_name, change for each rule whose column was moved, lost or restored."""
    side = lambda d, p: d.select("relation", "column_name", F.struct("position", "data_type").alias(p))
    both = side(old, "was").join(side(new, "now"), ["relation", "column_name"], "full_outer").join(rules, ["relation", "column_name"], "left_semi")
    change = F.when(F.col("now").isNull(), "lost").when(F.col("was").isNull(), "restored").when(F.col("was") != F.col("now"), "moved")
    return both.select("relation", "column_name", change.alias("change")).filter(F.col("change").isNotNull())
