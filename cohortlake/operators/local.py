"""Small tables of the driver (a row for each cell, sample or aggregate) as DataFrames without a Python job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def small_table(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """rows as one literal that the executors unfold. Values: None, bool, int, float, str and lists of these."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], kind)
    text = json.dumps([dict(zip(kind.names, r)) for r in rows])
    column = F.from_json(F.lit(text), f"array<{kind.simpleString()}>")
    return spark.range(0, 1, 1, 1).select(F.inline(column)).toDF(*kind.names)
