"""Readers for the usual example tables, in CSV or Parquet, with the roles of their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 4321


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header by its ending, anything else as Parquet."""
    if path.endswith((".csv", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def uniform(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the key alone: 48 bits of the MD5 of seed and key, the same in any engine that has it."""
    text = F.concat_ws("|", F.lit(str(seed)), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


#: Cohort 0 is never treated.
_NEVER = lambda name: F.nullif(F.col(name), F.lit(0))
#: Columns that each table gets, the key of its random weights, and its roles.
TABLES: dict[str, tuple[dict[str, Column | Callable], tuple[str, ...], dict[str, object]]] = {
    "mpdta": (
        {"first_treat": lambda: _NEVER("first_treat")},
        ("countyreal", "year"),
        {"entity_name": "countyreal", "time_name": "year", "cohort_name": "first_treat", "y_name": "lemp", "is_panel": True},
    ),
    "rc_two_periods": (
        {"time": lambda: F.when(F.col("post") == 1, 2000).otherwise(1999), "cohort": lambda: F.when(F.col("d") == 1, 2000)},
        ("id",),
        {"entity_name": "id", "time_name": "time", "cohort_name": "cohort", "y_name": "y", "is_panel": False},
    ),
    "rc_multi_period": (
        {"G": lambda: _NEVER("G")},
        ("id",),
        {"entity_name": "id", "time_name": "period", "cohort_name": "G", "y_name": "Y", "is_panel": False},
    ),
    "simulated_data": (
        {"T": lambda: F.to_timestamp("T"), "cohort": lambda: F.to_timestamp("cohort")},
        ("I", "T"),
        {"entity_name": "I", "time_name": "T", "cohort_name": "cohort", "y_name": "y", "is_panel": True},
    ),
}


def _load(spark: SparkSession, name: str, path: str, seed: int) -> dict[str, object]:
    columns, key, roles = TABLES[name]
    df = read_table(spark, path).withColumns({c: f() for c, f in columns.items()})
    return {"data": df.withColumn("random_weights", uniform(*key, seed=seed)), **roles}


def mpdta(spark: SparkSession, path: str, seed: int = SEED) -> dict[str, object]:
    """County employment: a balanced panel; cohort 0 is never treated."""
    return _load(spark, "mpdta", path, seed)


def rc_two_periods(spark: SparkSession, path: str, seed: int = SEED) -> dict[str, object]:
    """A repeated cross-section of two periods: post rows are of 2000, the others of 1999; the treated are of cohort 2000."""
    return _load(spark, "rc_two_periods", path, seed)


def rc_multi_period(spark: SparkSession, path: str, seed: int = SEED) -> dict[str, object]:
    """A repeated cross-section of several periods; cohort 0 is never treated."""
    return _load(spark, "rc_multi_period", path, seed)


def simulated_data(spark: SparkSession, path: str, separate: bool = False, bins: int = 3, seed: int = SEED) -> dict[str, object]:
    """A panel by timestamps (I, T, y, cohort, event_size), of single or several events for an entity.

    qevent_size: the bin of event_size, by quantiles of the table's distinct (cohort, event_size), merged on the cohort: a cohort
    with several sizes repeats its rows. separate: events (I, cohort, event_size, qevent_size) are a table of their own.
    """
    out = _load(spark, "simulated_data", path, seed)
    sizes = out["data"].select("cohort", "event_size").dropna().distinct()
    edges = sizes.agg(F.percentile("event_size", [k / bins for k in range(1, bins)]).alias("_edges"))
    binned = sizes.crossJoin(F.broadcast(edges)).select("cohort", F.size(F.filter("_edges", lambda e: e < F.col("event_size"))).alias("qevent_size"))  # one row of edges
    data = out["data"].join(F.broadcast(binned), "cohort", "left")  # distinct cohorts and sizes
    if not separate:
        return out | {"data": data}
    events = data.select("I", "cohort", "event_size", "qevent_size").dropna()
    return out | {"data": data.drop("cohort", "event_size"), "cohort_data": events}
