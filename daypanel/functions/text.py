"""Text cleaning and number repair for hand-made tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from daypanel.functions.missing import ColumnOrName, as_col, try_div


def num(x: ColumnOrName) -> Column:
    """Text to double, NULL where the text is no number."""
    return as_col(x).try_cast("double")


def num_comma(x: ColumnOrName) -> Column:
    """Text with thousands points and a decimal comma (``1.234,5``) to double."""
    return F.translate(as_col(x), ",.", ".").try_cast("double")


def comma_text(x: ColumnOrName) -> Column:
    """Number to text with a decimal comma, with all its digits; whole numbers without a fraction.

    Large and small numbers keep their exponent (``1,5E-13``), so reading the text gives the same number.
    """
    return F.translate(F.regexp_replace(as_col(x).cast("string"), r"\.0$", ""), ".", ",")


def replace_first(x: ColumnOrName, literal: str, replacement: str) -> Column:
    """Replace only the first occurrence of ``literal``."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(as_col(x), "(?s)^(.*?)" + re.escape(literal), "$1" + safe)


def strip_chars(x: ColumnOrName, chars: str) -> Column:
    """Remove every occurrence of each character of ``chars``."""
    return F.translate(as_col(x), chars, "")


def paste(*cols: ColumnOrName, sep: str = " ") -> Column:
    """Concatenate with a separator; a missing part is written as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(as_col(c).cast("string"), F.lit("NA")) for c in cols])


def repair_thousands(x: ColumnOrName) -> Column:
    """Undo a thousands point read as a decimal point: 1.234 becomes 1234, whole numbers stay."""
    c = as_col(x)
    return F.when(c % F.lit(1.0) == 0, c).otherwise(c * 1000)


def implied_thousands(count: ColumnOrName, per_100k: ColumnOrName) -> Column:
    """Inhabitants in thousands implied by a count and its rate per 100,000."""
    return try_div(count, per_100k) * 100


def daily_per_100(new: ColumnOrName, thousands: ColumnOrName) -> Column:
    """New cases per 100 inhabitants, given inhabitants in thousands."""
    return try_div(new, thousands) / 10
