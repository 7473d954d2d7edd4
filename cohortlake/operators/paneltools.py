"""Event-study and balancing helpers over a panel's (entity, time) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_times(df: DataFrame, entity: str, time: str) -> DataFrame:
    """entity, time: the times missing between an entity's observed ones."""
    before = F.lag(time).over(Window.partitionBy(entity).orderBy(time))
    gaps = df.select(entity, time).distinct().withColumn("_before", before).filter(F.col(time) > F.col("_before") + 1)
    return gaps.select(entity, F.explode(F.sequence(F.col("_before") + 1, F.col(time) - 1)).alias(time))


def has_gaps(df: DataFrame, entity: str, time: str) -> bool:
    return bool(missing_times(df, entity, time).limit(1).count())


def fill_gaps(df: DataFrame, entity: str, time: str, fill: float | None = None) -> DataFrame:
    """df with a row for each missing time; other columns are fill (null)."""
    out = df.unionByName(missing_times(df, entity, time), allowMissingColumns=True)
    return out if fill is None else out.fillna(fill)


def reindex_times(df: DataFrame, entity: str, time: str, start: int | None = None, end: int | None = None, fill: float | None = None) -> DataFrame:
    """A row for every time of every entity from its first to its last (or from start to end)."""
    a, b = (F.min(time) if start is None else F.lit(start)), (F.max(time) if end is None else F.lit(end))
    spans = df.groupBy(entity).agg(a.alias("_a"), b.alias("_b")).filter("_a <= _b")
    every = spans.select(entity, F.explode(F.sequence("_a", "_b")).alias(time)).withColumn(time, F.col(time).cast(dict(df.dtypes)[time]))
    out = every.join(df, [entity, time], "left")
    return out if fill is None else out.fillna(fill)


def entities_per_window(df: DataFrame, entity: str, time: str, periods: int) -> DataFrame:
    """start, end, n: for each window of so many periods, the entities observed in all of them."""
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    if lo is None or lo + periods - 1 > hi:
        return df.sparkSession.createDataFrame([], "start int, end int, n long")
    seen = df.select(F.col(entity).alias("e"), F.col(time).cast("int").alias("t")).distinct()
    first = F.sequence(F.greatest(F.col("t") - (periods - 1), F.lit(lo)), F.least(F.col("t"), F.lit(hi - periods + 1)))
    per = seen.filter(F.greatest(F.col("t") - (periods - 1), F.lit(lo)) <= F.least(F.col("t"), F.lit(hi - periods + 1))).withColumn("start", F.explode(first)).groupBy("start", "e").agg(F.count("*").alias("k"))
    found = per.groupBy("start").agg(F.count_if(F.col("k") >= periods).alias("n"))
    every = df.sparkSession.range(lo, hi - periods + 2).select(F.col("id").cast("int").alias("start"))
    return every.join(found, "start", "left").select("start", (F.col("start") + periods - 1).alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def balanced_windows(df: DataFrame, entity: str, time: str, periods: int | None = None, grow: bool = True) -> DataFrame:
    """start, end, n of the windows with most fully observed entities; grow: longer windows that lose none."""
    if periods is not None and periods <= 1:
        raise ValueError("'periods' must be > 1")
    periods = periods or df.groupBy(entity).agg(F.countDistinct(time).alias("n")).agg(F.max("n")).first()[0]
    best = entities_per_window(df, entity, time, periods)
    most = best.agg(F.max("n")).first()[0]
    found = best.filter(F.col("n") == most)
    while grow and most:
        periods += 1
        best = entities_per_window(df, entity, time, periods)
        new = best.agg(F.max("n")).first()[0]
        if new is None or new < most:
            break
        most, found = new, best.filter(F.col("n") == new)
    return found


def fully_observed(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Rows of entities seen at as many times as any."""
    per = df.groupBy(entity).agg(F.countDistinct(time).alias("_n"))
    most = per.agg(F.max("_n").alias("_most"))
    keep = per.join(F.broadcast(most), F.col("_n") == F.col("_most")).select(entity)
    return df.join(keep, entity, "left_semi")


#: Events of one entity at most: each becomes a column.
MOST_EVENTS = 1000


def cohort_table(events: DataFrame, entity: str, value: str, most: int | None = None, panel: DataFrame | None = None, time: str | None = None, gaps: bool = True) -> DataFrame:
    """A row for each entity, its events' values (times or intensities) in columns 1, 2, ... by time.

    panel: a row for each of its (entity, time) of entities with events instead; gaps: for missing times between them, too.
    """
    number = F.row_number().over(Window.partitionBy(entity).orderBy("cohort"))
    numbered = events.withColumn("_n", number)
    most = most or numbered.agg(F.max("_n")).first()[0] or 0
    if most > MOST_EVENTS:
        raise ValueError(f"an entity has {most} events: more than {MOST_EVENTS}")
    wide = numbered.groupBy(entity).pivot("_n", list(range(1, most + 1))).agg(F.first(value))
    if panel is None:
        return wide
    seen = panel.select(entity, time)
    if gaps:
        spans = seen.groupBy(entity).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
        seen = spans.select(entity, F.explode(F.sequence("_a", "_b")).alias(time)).withColumn(time, F.col(time).cast(dict(panel.dtypes)[time]))
    return seen.join(wide, entity)


def relative_periods(panel: DataFrame, events: DataFrame, entity: str, time: str, intensity: str | None = None) -> DataFrame:
    """entity, time, relative_period, intensity: one row for each of the entity's events."""
    rows = panel.select(entity, time).join(events.select(entity, "cohort", *([intensity] if intensity else [])), entity)
    value = F.col(intensity) if intensity else F.lit(1)
    return rows.select(entity, time, (F.col(time) - F.col("cohort")).alias("relative_period"), value.alias("intensity"))


def relative_dummies(panel: DataFrame, events: DataFrame, entity: str, time: str, start: int | None = None, end: int | None = None, intensity: str | None = None) -> DataFrame:
    """A column for each relative period from start to end (named p_-1, p_0, ...): the sum over the entity's events."""
    periods = relative_periods(panel, events, entity, time, intensity)
    lo, hi = periods.agg(F.min("relative_period"), F.max("relative_period")).first()
    start, end = (lo if start is None else start), (hi if end is None else end)
    if start is None or start > end:
        raise ValueError("'start' must be <= 'end'")
    sums = [F.sum(F.when(F.col("relative_period") == p, F.col("intensity")).otherwise(0)).alias(f"p_{p}") for p in range(start, end + 1)]
    return periods.groupBy(entity, time).agg(*sums)


def binned_dummies(dummies: DataFrame, entity: str, time: str, bin_start: bool = True, bin_end: bool = True) -> DataFrame:
    """The end columns stand for all periods beyond them: running sums by entity, from behind for the first, ahead for the last."""
    names = sorted((c for c in dummies.columns if c.startswith("p_")), key=lambda c: int(c[2:]))
    if len(names) < 2 and bin_start and bin_end:
        raise ValueError("with one period, bin either the start or the end")
    own = Window.partitionBy(entity).orderBy(time)
    behind, ahead = own.rowsBetween(0, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    if bin_start:
        out[names[0]] = F.sum(names[0]).over(behind)
    if bin_end:
        out[names[-1]] = F.sum(names[-1]).over(ahead)
    return dummies.withColumns(out)
