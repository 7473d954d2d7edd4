"""Timestamps as whole numbers, by arithmetic alone: years, or steps of a frequency counted from 1000."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARLY = {"A", "AS", "Y", "YS", "YE", "A-DEC", "YE-DEC"}
#: The unit of each frequency, and how many of it a step takes.
STEPS = {
    "D": ("DAY", 1), "B": ("DAY", 1), "W": ("DAY", 7), "W-MON": ("DAY", 7), "W-SUN": ("DAY", 7), "M": ("MONTH", 1), "MS": ("MONTH", 1), "ME": ("MONTH", 1),
    "Q": ("MONTH", 3), "QS": ("MONTH", 3), "QE": ("MONTH", 3), "H": ("HOUR", 1), "h": ("HOUR", 1),
}
#: Dates of these are the ends of months.
ENDS = {"M", "ME", "Q", "QE"}
FIRST = 1000
_MONDAY = date(1970, 1, 5)


@dataclass
class Calendar:
    """Steps of freq from the first time on. A time between two steps has no number."""

    first: datetime
    freq: str

    def _months(self, column: Column) -> Column:
        return F.year(column) * 12 + F.month(column)

    def _work_days(self, column: Column) -> Column:
        """Days from Monday to Friday since a Monday; null at weekends."""
        days = F.datediff(column.cast("date"), F.lit(_MONDAY))
        return F.when(F.pmod(days, F.lit(7)) < 5, F.floor(days / 7) * 5 + F.pmod(days, F.lit(7)))

    def number(self, column: Column) -> Column:
        """The number of a timestamp."""
        if self.freq in YEARLY:
            return F.year(column)
        column, first = column.cast("timestamp"), F.lit(self.first).cast("timestamp")
        unit, each = STEPS[self.freq]
        if self.freq == "B":
            steps = self._work_days(column) - self._work_days(first)
        elif self.freq in ENDS:
            steps = F.floor((self._months(column) - self._months(first)) / each)
        else:
            steps = F.floor(F.timestamp_diff(unit, first, column) / each)
        number = (steps + FIRST).cast("int")
        return F.when(self.date(number) == column, number)

    def date(self, number: Column) -> Column:
        """The timestamp of a number."""
        if self.freq in YEARLY:
            return F.make_timestamp(number, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
        first, steps = F.lit(self.first).cast("timestamp"), number - FIRST
        unit, each = STEPS[self.freq]
        if self.freq == "B":
            day = steps + self._work_days(first)
            return F.timestamp_add("DAY", (F.floor(day / 5) * 7 + F.pmod(day, F.lit(5)) - F.datediff(first.cast("date"), F.lit(_MONDAY))).cast("int"), first)
        if self.freq in ENDS:
            return F.last_day(F.add_months(F.trunc(first, "month"), steps * each)).cast("timestamp")
        return F.timestamp_add(unit, steps * each, first)


def calendar_of(df: DataFrame, time: str, freq: str | None) -> Calendar:
    """The calendar from the first time of df. Raises where freq is missing or unknown."""
    if freq is None:
        raise TypeError("times are timestamps: 'freq' is needed")
    if freq not in YEARLY and freq not in STEPS:
        raise ValueError(f"unknown freq {freq!r}")
    first = df.agg(F.min(F.col(time).cast("timestamp"))).first()[0] if freq not in YEARLY else None
    return Calendar(first or datetime(1970, 1, 1), freq)


def calendar(df: DataFrame, time: str, freq: str | None) -> DataFrame:
    """date, number: every step from the first to the last time."""
    steps = calendar_of(df, time, freq)
    last = F.max(steps.number(F.col(time))).alias("b")
    numbers = df.agg(F.min(steps.number(F.col(time))).alias("a"), last).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("number"))
    return numbers.select(steps.date(F.col("number")).alias("date"), "number")
