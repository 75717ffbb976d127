"""Dates as whole numbers YYYYMMDD, periods as their prefixes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_DAY, LAST_DAY = 19000101, 20301231


def day_number(date: Column) -> Column:
    return (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("int")


def to_day(number: Column) -> Column:
    return F.try_to_date(number.cast("string"), "yyyyMMdd")


def parse_day(text: Column) -> Column:
    """The first ten characters without dashes as a number; null if the text is shorter or something else."""
    return F.when(F.length(text) >= 10, F.regexp_replace(F.substring(text, 1, 10), "-", "").try_cast("int"))


def in_range(day: Column) -> Column:
    return day.between(FIRST_DAY, LAST_DAY)


def year(day: Column) -> Column:
    return F.floor(day / 10000).cast("int")


def month(day: Column) -> Column:
    return (F.floor(day / 100) % 100).cast("int")


def period(day: Column, resolution: str) -> Column:
    return {"day": day, "month": F.floor(day / 100).cast("int"), "year": F.floor(day / 10000).cast("int")}[resolution]


def semester(day: Column) -> Column:
    return (year(day) * 2 + (month(day) > 6).cast("int")).cast("int")


def semester_label(s: Column) -> Column:
    return F.concat(F.floor(s / 2).cast("string"), F.when(s % 2 == 0, F.lit("-01")).otherwise(F.lit("-07")))


def bound(text: Column, upper: bool) -> Column:
    """A partial date as the first or last day that it may mean: 8, 6 or 4 digits."""
    digits = F.regexp_replace(text, r"\D", "")
    n = digits.try_cast("int")
    return F.when(F.length(digits) == 8, n).when(F.length(digits) == 6, n * 100 + (31 if upper else 1)).otherwise(n * 10000 + (1231 if upper else 101))


def parse_bound(text: str, upper: bool) -> int:
    digits = re.sub(r"\D", "", text)
    tail = {8: "", 6: "31" if upper else "01"}.get(len(digits), "1231" if upper else "0101")
    return int(digits + tail)


def period_bounds(value: Column, resolution: Column) -> tuple[Column, Column]:
    low = F.when(resolution == "year", value * 10000 + 101).when(resolution == "month", value * 100 + 1).otherwise(value)
    high = F.when(resolution == "year", value * 10000 + 1231).when(resolution == "month", value * 100 + 31).otherwise(value)
    return low, high
