"""Group-time cells: which cohort is compared over which two times (in which stratum)."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .local import small_table


Cell = tuple[int, int, int]


def seen(panel: DataFrame) -> list[tuple[int, int | None]]:
    """The distinct (t, g) of a panel: times by cohorts, few."""
    return [(r["t"], r["g"]) for r in panel.select("t", "g").distinct().collect()]


def planned(grid: list[tuple], anticipation: int = 0, base_period: str = "varying") -> list[Cell]:
    """(cohort, base_period, time) from (t, g, ...) rows.

    varying: before treatment the base is the time before, then the last time before treatment (less anticipation).
    universal: that time is the base of every time, of itself too.
    """
    if anticipation < 0:
        raise ValueError("'anticipation' must be >= 0")
    times = sorted({r[0] for r in grid if r[0] is not None})
    out = []
    for cohort in sorted({r[1] for r in grid if r[1] is not None}):
        early = bisect_left(times, cohort - anticipation)
        if not times or cohort <= times[0] + anticipation or early == 0:
            continue
        last = times[early - 1]
        if base_period == "universal":
            out += [(cohort, last, t) for t in times]
        else:
            out += [(cohort, last if t >= cohort else before, t) for before, t in zip(times, times[1:])]
    return out


def possible(cells: list[Cell], grid: list[tuple]) -> list[Cell]:
    """Cells whose cohort is observed at both times, and those whose times are one."""
    have = {(r[1], r[0]) for r in grid}
    return [c for c in cells if c[1] == c[2] or ((c[0], c[1]) in have and (c[0], c[2]) in have)]


CELLS = "cohort int, base_period int, time int"


def varying(panel: DataFrame, anticipation: int = 0) -> DataFrame:
    """cohort, base_period, time. panel: t, g."""
    return small_table(panel.sparkSession, planned(seen(panel), anticipation), CELLS)


def universal(panel: DataFrame, anticipation: int = 0) -> DataFrame:
    return small_table(panel.sparkSession, planned(seen(panel), anticipation, "universal"), CELLS)


def stratum(panel: DataFrame, strata: str) -> Column:
    """The column of strata: NaN is null, and whole floats are integers if all of them are whole."""
    column = F.col(strata)
    if dict(panel.dtypes)[strata] not in ("double", "float"):
        return column
    column = F.when(~F.isnan(column), column)
    return column if panel.filter(column != F.floor(column)).limit(1).count() else column.cast("long")


def strata_of(panel: DataFrame, strata: str) -> DataFrame:
    """The distinct strata, as stratum."""
    return panel.select(stratum(panel, strata).alias("stratum")).filter("stratum is not null").distinct()


def by_stratum(cells: DataFrame, panel: DataFrame, strata: str) -> DataFrame:
    """The cells once for each stratum."""
    return cells.crossJoin(F.broadcast(strata_of(panel, strata)))  # a row for each cell and stratum


def feasible(cells: DataFrame, panel: DataFrame) -> DataFrame:
    """Cells whose cohort is observed at both times, and those whose times are one."""
    at = panel.select(F.col("g").alias("cohort"), F.col("t").alias("at")).distinct()
    both = cells
    for c in ("base_period", "time"):
        both = both.join(at.withColumnRenamed("at", c), ["cohort", c], "left_semi")
    return both.unionByName(cells.filter("base_period = time")).distinct().select(*cells.columns)


def chosen(cells: DataFrame, **by: object) -> DataFrame:
    """Filters cells or results by cohort, time, stratum, base_period or relative_period: a value, a list, or (start, end)
    as a tuple with None for an open side."""
    for name, want in by.items():
        column: Column = F.col("time") - F.col("cohort") if name == "relative_period" and name not in cells.columns else F.col(name)
        if isinstance(want, tuple):
            start, end = want
            cells = cells.filter(column >= start) if start is not None else cells
            cells = cells.filter(column <= end) if end is not None else cells
        else:
            cells = cells.filter(column.isin(want if isinstance(want, list) else [want]))
    return cells


def chosen_results(results: DataFrame, post: bool = False, pre: bool = False, influence: bool = False, **by: object) -> DataFrame:
    """Results with an effect, of ``chosen`` cells; post, pre: after or before treatment alone; influence: of those whose influence is not all zero."""
    out = chosen(results.filter(F.col("ATT").isNotNull() & ~F.isnan("ATT")), **by)
    out = post_treatment(out) if post else out
    out = post_treatment(out, False) if pre else out
    return out.filter("std_error is not null") if influence else out  # a zero error is null


def post_treatment(cells: DataFrame, post: bool = True) -> DataFrame:
    return cells.filter(F.col("time") >= F.col("cohort") if post else F.col("time") < F.col("cohort"))
