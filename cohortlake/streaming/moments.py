"""Unit by time means of a stream of measurements, with a watermark: what a panel's cells are made of, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, entity: str, ts: str, value: str, width: str = "7 days", late: str = "1 day", origin: str = "4 days") -> DataFrame:
    """entity, time (start of its window), n, y. origin shifts windows: from 1970-01-01, a Thursday, 4 days reach a Monday."""
    windowed = stream.withWatermark(ts, late).groupBy(entity, F.window(ts, width, width, origin).alias("span"))
    return windowed.agg(F.count(value).alias("n"), F.avg(value).alias("y")).select(entity, F.col("span.start").alias("time"), "n", "y")
