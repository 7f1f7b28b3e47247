"""Window columns over one ordered series. Offsets count rows, not days.

A series is one region ordered by date. The panels here hold one row per region and day, so a series
is never longer than the calendar, however many raw records its region had.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F

from daypanel.functions.missing import ColumnOrName, as_col, try_div


def series(region: str = "region", date: str = "date") -> WindowSpec:
    return Window.partitionBy(region).orderBy(date)


def shift(x: ColumnOrName, rows: int, w: WindowSpec, default: float | None = 0.0) -> Column:
    """Value ``rows`` earlier; rows before the start give ``default``, missing values stay missing."""
    return F.lag(as_col(x), rows, default).over(w)


def change(x: ColumnOrName, w: WindowSpec, rows: int = 1) -> Column:
    """Change over ``rows`` rows, counting from zero before the start."""
    return as_col(x) - shift(x, rows, w)


def change_or_null(x: ColumnOrName, w: WindowSpec) -> Column:
    """Change to the previous row, NULL on the first."""
    return as_col(x) - F.lag(as_col(x)).over(w)


def shifted_change(x: ColumnOrName, rows: int, w: WindowSpec) -> Column:
    """The daily change ``rows`` rows earlier, from two offsets of the total instead of nested windows."""
    return shift(x, rows, w) - shift(x, rows + 1, w)


def lead_growth(x: ColumnOrName, w: WindowSpec) -> Column:
    """Growth rate to the next row."""
    return try_div(F.lead(as_col(x)).over(w), x) - 1


def rate_per_previous(new: ColumnOrName, stock: ColumnOrName, w: WindowSpec) -> Column:
    """New cases per case that was active on the row before."""
    return try_div(new, F.lag(as_col(stock)).over(w))


def row_index(w: WindowSpec) -> Column:
    return F.row_number().over(w)
