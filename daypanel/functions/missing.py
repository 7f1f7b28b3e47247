"""Column functions with explicit rules for missing and undefined values.

One rule holds throughout: a missing input gives a missing result, and an undefined result
(division by zero, logarithm base one) is NULL as well, never NaN or infinity.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den`` in double, NULL where the denominator is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def sum_strict(x: ColumnOrName) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    return F.when(F.count(as_col(x)) == F.count(F.lit(1)), F.sum(as_col(x)))


def sum_or_zero(x: ColumnOrName) -> Column:
    """Sum over the present values, zero when there are none."""
    return F.coalesce(F.sum(as_col(x)), F.lit(0.0))


def cumsum_strict(x: ColumnOrName, w: WindowSpec) -> Column:
    """Running sum over ordered window ``w`` that stays NULL from the first NULL on."""
    up_to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    complete = F.count(as_col(x)).over(up_to_here) == F.count(F.lit(1)).over(up_to_here)
    return F.when(complete, F.sum(as_col(x)).over(up_to_here))


def clamp_below(x: ColumnOrName, floor: float) -> Column:
    """Element-wise maximum with a constant; unlike ``greatest`` a NULL stays NULL."""
    return F.when(as_col(x).isNotNull(), F.greatest(as_col(x), F.lit(float(floor))))


def in_set(x: ColumnOrName, values: Iterable) -> Column:
    """Set membership where a NULL is not a member (false, not NULL)."""
    return F.coalesce(as_col(x).isin(list(values)), F.lit(False))


def not_in_set(x: ColumnOrName, values: Iterable) -> Column:
    """Negated membership that keeps NULL rows."""
    return ~in_set(x, values)


def fill_zero(x: ColumnOrName) -> Column:
    return F.coalesce(as_col(x), F.lit(0.0))


def round_even(x: ColumnOrName) -> Column:
    """Round to whole numbers, halves to the even neighbour."""
    return F.bround(as_col(x), 0)


def doubling_time(ratio: ColumnOrName, rows: int = 3) -> Column:
    """Rows needed to double when ``ratio`` was observed over ``rows`` rows.

    NULL for a flat series (ratio one) and for ratios that are not positive; negative when falling.
    """
    r = as_col(ratio)
    return F.when(r > 0, F.try_divide(F.ln(F.lit(float(2**rows))), F.ln(r)))


def flag_above(x: ColumnOrName, threshold: float, above: str, below: str) -> Column:
    """Two-way label by threshold; NULL stays NULL."""
    c = as_col(x)
    return F.when(c > threshold, F.lit(above)).when(c <= threshold, F.lit(below))


def interval_labels(breaks: Sequence[float]) -> list[str]:
    """Labels of right-closed intervals with three significant digits, e.g. ``(750,1.5e+03]``."""
    shown = [f"{b:.3g}" for b in breaks]
    return [f"({lo},{hi}]" for lo, hi in zip(shown, shown[1:])]


def cut_right(x: ColumnOrName, breaks: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Bin into right-closed intervals; the lowest break itself and values outside are NULL."""
    labels = interval_labels(breaks) if labels is None else list(labels)
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per interval")
    c = as_col(x)
    out = F.when((c > breaks[0]) & (c <= breaks[1]), F.lit(labels[0]))
    for lo, hi, label in zip(breaks[1:], breaks[2:], labels[1:]):
        out = out.when((c > lo) & (c <= hi), F.lit(label))
    return out
