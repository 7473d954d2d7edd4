"""Cells by units: the 2 x 2 cross-section of every cell, as one relation.

A balanced comparison needs a unit at both times of a cell. Units are gathered once (one shuffle by unit); every cell is then
a projection of a unit's own row, so the expansion by cells moves no data. Repeated cross-sections keep their rows and
meet the cells of their time.

rows: sample, cell_id, unit, d (treated), post (cross-sections only), y, x (array), w.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("cell_id", "cohort", "base_period", "time", "stratum")


def treated(strata: bool) -> Column:
    d = F.col("g") == F.col("cohort")
    if strata:
        d = d & (F.col("s") == F.col("stratum"))
    return F.coalesce(d, F.lit(False))


def control(control_group: str, strata: bool, anticipation: int) -> Column:
    """never: null cohort. not yet: or not treated in this cell and treated later than both its times."""
    never = F.col("g").isNull()
    if control_group == "never_treated":
        return never
    later = F.col("g") > F.greatest("time", "base_period") + anticipation
    return never | (~treated(strata) & F.coalesce(later, F.lit(False)))


def unit_rows(df: DataFrame, values: list[str], samples: bool) -> DataFrame:
    """unit, g, s, cluster, sample and obs (time -> values) of every unit. values: y, w, x, dx."""
    by = ["sample", "unit"] if samples else ["unit"]
    entry = F.struct("t", F.struct(*values))
    out = df.groupBy(*by).agg(F.max("g").alias("g"), F.max("s").alias("s"), F.map_from_entries(F.collect_list(entry)).alias("obs"))
    return out if samples else out.withColumn("sample", F.lit("full_sample"))


def met_cells(units: DataFrame, cells: DataFrame, control_group: str, strata: bool, anticipation: int) -> DataFrame:
    """Units by the cells they are treated or control in, by equality: a unit asks for the cells of its own cohort, and for
    those whose later time is one of the times at which it may serve as a control. d: whether it is treated there."""
    later = F.greatest("time", "base_period")
    kinds = F.array(F.struct(F.lit(True).alias("d"), F.col("cohort").alias("at")), F.struct(F.lit(False).alias("d"), later.alias("at")))
    keyed = cells.withColumn("_key", F.explode(kinds)).select("*", "_key.d", "_key.at").drop("_key")
    own = F.array(F.struct(F.lit(True).alias("d"), F.col("g").alias("at")))
    yet = (lambda t: F.lit(False)) if control_group == "never_treated" else (lambda t: F.coalesce(F.col("g") > t + anticipation, F.lit(False)))
    # a comparison needs a unit at both times of a cell, so the times it is observed at are all that it may serve
    times = F.transform(F.filter(F.map_keys("obs"), lambda t: F.col("g").isNull() | yet(t)), lambda t: F.struct(F.lit(False).alias("d"), t.alias("at")))
    asked = F.concat(F.when(F.col("g").isNotNull(), own).otherwise(F.array().cast("array<struct<d:boolean,at:int>>")), times)
    met = units.withColumn("_key", F.explode(asked)).select("*", "_key.d", "_key.at").drop("_key").join(F.broadcast(keyed), ["d", "at"])  # two rows for each cell
    return met.filter(F.col("d") == treated(strata))


def panel_rows(units: DataFrame, cells: DataFrame, control_group: str, strata: bool, anticipation: int, delta: bool) -> DataFrame:
    """y is the change of the outcome; x come from the earlier time, and changes of dx are appended."""
    met = met_cells(units, cells, control_group, strata, anticipation)
    met = met.withColumns({"a": F.col("obs")[F.col("base_period")], "b": F.col("obs")[F.col("time")]}).filter("a is not null and b is not null")
    early = F.when(F.col("time") < F.col("base_period"), F.col("b")).otherwise(F.col("a"))
    met = met.withColumn("early", early)
    x = F.col("early.x")
    if delta:
        x = F.concat(x, F.zip_with("b.dx", "a.dx", lambda b, a: b - a))
    return met.select("sample", "cell_id", "unit", F.col("d").cast("double").alias("d"), (F.col("b.y") - F.col("a.y")).alias("y"), x.alias("x"), F.col("early.w").alias("w"))


def cross_section_rows(df: DataFrame, cells: DataFrame, control_group: str, strata: bool, anticipation: int) -> DataFrame:
    """Every row at one of a cell's two times, if treated or control there. df: sample, unit, t, g, s, y, x, w."""
    d, c = treated(strata), control(control_group, strata, anticipation)
    at = cells.withColumn("at", F.explode(F.array("time", "base_period")))  # an equality, so rows meet only their time's cells
    met = df.join(F.broadcast(at), (F.col("t") == F.col("at")) & (d | c))
    return met.select("sample", "cell_id", "unit", d.cast("double").alias("d"), (F.col("t") == F.col("time")).cast("double").alias("post"), "y", "x", "w")
