"""Row filters of the panel reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from daypanel.functions.missing import ColumnOrName, as_col
from daypanel.operators.reshape import q


def exclude_cells(df: DataFrame, cells: Iterable[tuple[str, dt.date]], region: str = "region", date: str = "date") -> DataFrame:
    """Drop known outliers, each named by region and date; rows with a missing region or date are kept."""
    out = df
    for name, day in cells:
        hit = (q(region) == F.lit(name)) & (q(date) == F.lit(day))
        out = out.where(~F.coalesce(hit, F.lit(False)))
    return out


def same_weekday(df: DataFrame, as_of: dt.date, date: str = "date") -> DataFrame:
    """Weekly sample: rows on the weekday of the day before the report day."""
    return df.where(F.weekday(q(date)) == (as_of - dt.timedelta(days=1)).weekday())


def two_snapshots(df: DataFrame, as_of: dt.date, stamp: str = "update", days: int = 7) -> DataFrame:
    """Rows of the report day and of the day ``days`` earlier."""
    return df.where(F.to_date(q(stamp)).isin(as_of, as_of - dt.timedelta(days=days)))


def within(df: DataFrame, x: ColumnOrName, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows inside a closed axis range, applied before a smoother sees them."""
    c = as_col(x)
    out = df if low is None else df.where(c >= low)
    return out if high is None else out.where(c <= high)


def positive(df: DataFrame, x: ColumnOrName) -> DataFrame:
    """Rows a logarithmic axis can show."""
    return df.where(as_col(x) > 0)


def matching(df: DataFrame, x: ColumnOrName, pattern: str, keep: bool = True) -> DataFrame:
    """Rows whose text contains (or, with ``keep=False``, lacks) the pattern; missing text is dropped."""
    hit = as_col(x).rlike(pattern)
    return df.where(hit if keep else ~hit)
