"""Panels and repeated cross-sections: validation, classification and the rules for treated entities.

A panel's rows are keyed by (entity, time); the cohort is the first treated time, null for never. One window pass by
entity gives each row its entity's cohort and first and last time; classification is one aggregate.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.calendar import Calendar, calendar_of

#: The engine's own columns beside the caller's: entity, time and cohort as numbers, and an entity's first and last time.
UNIT, T, G, FIRST, LAST = "_unit", "_t", "_g", "_first", "_last"
RESERVED = ("_relative_time", "_cohort", "_treated", "_control", "_after_event", "_w", UNIT, T, G, FIRST, LAST)
TIMES = ("timestamp", "date", "timestamp_ntz")


@dataclass
class Panel:
    """df has the caller's columns, whatever their names, and _unit, _t, _g (null: never treated)."""

    df: DataFrame
    entity: str
    time: str
    cohort: str
    is_panel: bool
    is_balanced: bool
    no_never_treated: bool = False
    #: Where times are timestamps.
    dates: Calendar | None = None
    notes: list[str] = field(default_factory=list)
    #: (time, cohort, rows) of df.
    grid: list[tuple] = field(default_factory=list)


def no_nan(df: DataFrame, column: str) -> Column:
    """The column with NaN as null."""
    return F.when(F.isnan(column), None).otherwise(F.col(column)) if dict(df.dtypes)[column] in ("double", "float") else F.col(column)


def with_spans(df: DataFrame) -> DataFrame:
    """df with its entity's cohort as _g, and first and last time as _first and _last."""
    own = Window.partitionBy(UNIT)
    return df.withColumns({G: F.max(G).over(own), FIRST: F.min(T).over(own), LAST: F.max(T).over(own)})


def drop_always_treated(df: DataFrame) -> DataFrame:
    """Without entities whose cohort is not after their own first time. df: of with_spans."""
    return df.filter(F.col(G).isNull() | (F.col(G) > F.col(FIRST)))


def treated_after_to_never(df: DataFrame) -> DataFrame:
    """Cohorts after an entity's own last time become null. df: of with_spans."""
    return df.withColumn(G, F.when(F.col(G) <= F.col(LAST), F.col(G)))


def last_cohort_as_control(df: DataFrame, last: int, anticipation: int = 0) -> DataFrame:
    """The last cohort counts as never treated, and only times before it (less anticipation) stay."""
    return df.filter(F.col(T) < last - anticipation).withColumn(G, F.when(F.col(G) != last, F.col(G)))


def is_balanced(df: DataFrame, time: str = T) -> bool:
    """Whether all times have the same number of rows."""
    r = df.groupBy(time).count().agg(F.min("count"), F.max("count")).first()
    return r[0] == r[1]


def time_varying(df: DataFrame, entity: str, columns: list[str], rtol: float | None = None, atol: float | None = None, time: str | None = None) -> list[str]:
    """Columns with more than one value within some entity; with tolerances, with neighbouring values further apart than these."""
    if not columns:
        return []
    if rtol is None and atol is None:
        wide = df.groupBy(entity).agg(*(F.countDistinct(c).alias(c) for c in columns)).agg(*(F.max(c).alias(c) for c in columns)).first()
        return [c for c in columns if (wide[c] or 0) > 1]
    rtol, atol = rtol or 1e-5, atol or 1e-8
    order = Window.partitionBy(entity).orderBy(time or T)
    far = [F.max(F.abs(F.col(c) - F.col(f"_{c}")) > atol + rtol * F.abs(f"_{c}")).alias(c) for c in columns]
    row = df.select(*columns, *(F.lag(c).over(order).alias(f"_{c}") for c in columns)).agg(*far).first()
    return [c for c in columns if row[c]]


def prepare(
    data: DataFrame,
    entity: str,
    time: str,
    cohort: str,
    anticipation: int = 0,
    freq: str | None = None,
    cohort_data: DataFrame | None = None,
    warn: bool = True,
) -> Panel:
    """Validates data and applies the rules for treated entities. cohort_data: entity and cohort, if not in data."""
    if bad := [c for c in data.columns if c.lower() in RESERVED]:
        raise ValueError(f"reserved column names: {bad}")
    if cohort_data is not None:
        if cohort_data.groupBy(entity, cohort).count().filter("count > 1").limit(1).count():
            raise ValueError("cohort_data repeats an entity and cohort")
        data = data.drop(cohort).join(cohort_data.select(entity, cohort), entity, "left")
    kinds = dict(data.dtypes)
    dated = kinds[time] in TIMES
    if dated != (kinds[cohort] in TIMES):
        raise ValueError("time and cohort must both be numbers or both be timestamps")
    dates = None
    if dated:
        dates = calendar_of(data, time, freq)
        t, g = dates.number(F.col(time)), dates.number(F.col(cohort))
    else:
        t, g = F.col(time).cast("int"), no_nan(data, cohort).cast("int")
    df = data.withColumns({UNIT: F.col(entity), T: t, G: g})
    per = df.groupBy(UNIT).agg(F.count("*").alias("n"), F.count(G).alias("k"), F.max(G).alias("g"), F.min(G).alias("g0"), F.min(T).alias("a"), F.max(T).alias("b"))
    early, late = F.coalesce(F.col("g") <= F.col("a"), F.lit(False)), F.coalesce(F.col("g") > F.col("b"), F.lit(False))
    s = per.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("units"),
        F.sum("k").alias("treated"),
        F.min("g0").alias("g0"),
        F.min("a").alias("t0"),
        F.count_if(early).alias("early"),
        F.count_if(late & ~early).alias("late"),
        F.count_if(~early & (late | F.col("g").isNull())).alias("never"),
        F.max(F.when(~early & ~late, F.col("g"))).alias("last"),
        F.count_if((F.col("k") > 0) & ((F.col("k") < F.col("n")) | (F.col("g0") < F.col("g")))).alias("mixed"),
    ).first()
    if s["n"] == s["treated"] and s["g0"] == 0 and s["t0"] != 0:
        raise ValueError("never-treated entities must have a null cohort, not 0")
    notes: list[str] = []
    flag = False
    is_panel = s["units"] != s["n"] and s["units"] > 0
    if is_panel:
        if s["early"] or s["late"] or s["mixed"]:  # else every row has its entity's cohort, and no rule applies
            df = treated_after_to_never(drop_always_treated(with_spans(df))).drop(FIRST, LAST)
        if s["early"]:
            notes.append(f"{s['early']} entities dropped: always treated (from before their first time)")
        if s["late"]:
            notes.append(f"{s['late']} entities count as never treated: treated after their last time")
        flag = s["never"] == 0 and s["last"] is not None
        if flag:
            df = last_cohort_as_control(df, s["last"], anticipation)
            notes.append("no never treated entities: the last cohort is the comparison group, and only earlier times are kept")
    for note in notes if warn else ():
        warnings.warn(note, stacklevel=3)
    grid = [(r[T], r[G], r["n"]) for r in df.groupBy(T, G).agg(F.count("*").alias("n")).collect()]  # times x cohorts
    sizes = row_counts(grid)
    return Panel(df, entity, time, cohort, is_panel, is_panel and len(set(sizes.values())) <= 1, flag, dates, notes, grid)


def row_counts(grid: list[tuple]) -> dict[int, int]:
    """Rows of each time, from (time, cohort, rows)."""
    out: dict[int, int] = {}
    for t, _, n in grid:
        out[t] = out.get(t, 0) + n
    return out
