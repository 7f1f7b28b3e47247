"""Dates: tolerant parsing, serial numbers, weekday names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from daypanel.functions.missing import ColumnOrName, as_col

# Weekday names, Monday first.
WEEKDAYS = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")


def date_mdy(x: ColumnOrName) -> Column:
    """``1/22/20`` or ``1/22/2020`` to a date, NULL when it does not parse; years 69 to 99 are 19xx."""
    short = F.try_to_date(as_col(x), "M/d/yy")
    in_century = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    return F.coalesce(in_century, F.try_to_date(as_col(x), "M/d/yyyy"))


def date_ymd(x: ColumnOrName) -> Column:
    return F.try_to_date(as_col(x), "yyyy-MM-dd")


def date_yyyymmdd(x: ColumnOrName) -> Column:
    """Leading ``YYYYMMDD`` of a longer stamp to a date."""
    return F.try_to_date(F.substring(as_col(x), 1, 8), "yyyyMMdd")


def timestamp_ymd_hms(x: ColumnOrName) -> Column:
    """``2020-05-24 09:30:00`` to a timestamp without time zone, NULL when it does not parse."""
    return as_col(x).try_cast("timestamp_ntz")


def serial_date(x: ColumnOrName) -> Column:
    """Spreadsheet day number (text or number) to a date: 43922 is 2020-04-01."""
    days = F.floor(as_col(x).try_cast("double")).try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), days)


def add_days(x: ColumnOrName, days: int | Column) -> Column:
    return F.date_add(as_col(x), days)


def weekday_label(x: ColumnOrName, mode: str = "true") -> Column:
    """German weekday name of a date.

    ``mode="level_order"`` gives what relabelling the alphabetically sorted names by position gives:
    the label of a Donnerstag is then Dienstag, because Donnerstag sorts second.
    """
    if mode == "true":
        names = WEEKDAYS
    elif mode == "level_order":
        names = tuple(WEEKDAYS[sorted(WEEKDAYS).index(day)] for day in WEEKDAYS)
    else:
        raise ValueError("mode is 'true' or 'level_order'")
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(as_col(x)) + 1)
