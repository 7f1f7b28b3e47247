"""Panels with missing days: rows for the days between, and offsets that count days."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from daypanel.functions.missing import ColumnOrName, as_col
from daypanel.operators.reshape import q

#: What a filled day holds: the last value, zero, nothing, or the value on the line to the next one.
RULES = ("carry", "zero", "null", "linear")


def fill_days(
    df: DataFrame,
    rules: Mapping[str, str],
    region: str = "region",
    date: str = "date",
    first: Column | None = None,
    last: Column | None = None,
    filled: str | None = None,
) -> DataFrame:
    """One row per region and day from the region's first day to its last, columns (region, date, measures, ``filled``).

    ``rules`` names the measures with their rule. ``first`` and ``last`` widen the range, for example to the first and last
    day of all regions as scalar subqueries: days before a region's first row are zero under ``carry`` and ``zero`` and missing
    otherwise; after its last row ``linear`` has no line and is missing. A present row is never changed, a missing value
    stays missing and is carried as such. The rows of a region are spread forward to the day before the next one, so no grid
    is joined and one sort by region does. The frame holds one row per region and day; rows without a day are dropped.
    """
    unknown = set(rules.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules {sorted(unknown)}")
    w = Window.partitionBy(q(region)).orderBy(q(date))
    names = list(rules)
    rows = df.where(q(date).isNotNull()).select(
        q(region).alias("r"), q(date).alias("d"), *[q(c).alias(f"m{i}") for i, c in enumerate(names)],
        F.lead(q(date)).over(w).alias("until"), (F.row_number().over(w) == 1).alias("opens"),
        *[F.lead(q(c)).over(w).alias(f"next{i}") for i, c in enumerate(names)],
        (q(date) if first is None else F.least(q(date), first)).alias("lo"),
        (q(date) if last is None else F.greatest(q(date), last)).alias("hi"),
    )
    day = lambda n: F.unix_date(n)
    own = F.sequence(F.col("d"), F.coalesce(F.date_sub("until", 1), F.col("hi")))
    before = F.when(F.col("opens") & (F.col("lo") < F.col("d")), F.sequence("lo", F.date_sub("d", 1))).otherwise(F.array().cast("array<date>"))
    spread = rows.withColumn("day", F.explode(F.concat(before, own)))
    made, early = F.col("day") != F.col("d"), F.col("day") < F.col("d")
    out = []
    for i, (name, rule) in enumerate(rules.items()):
        x, then = F.col(f"m{i}"), F.col(f"next{i}")
        share = (day("day") - day("d")) / (day("until") - day("d"))
        zero = F.lit(0).cast(df.schema[name].dataType)
        between = {"carry": F.when(early, zero).otherwise(x), "zero": zero, "null": F.lit(None), "linear": F.when(~early, x + (then - x) * share)}[rule]
        out.append(F.when(made, between).otherwise(x).alias(name))
    return spread.select(F.col("r").alias(region), F.col("day").alias(date), *out, *([made.alias(filled)] if filled else []))


def days(region: str = "region", date: str = "date") -> WindowSpec:
    """A series by day number, for offsets that count days."""
    return Window.partitionBy(q(region)).orderBy(F.unix_date(q(date)))


def shift_days(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    """Value of the row exactly ``n`` days earlier, NULL where that day has no row. ``w`` comes from ``days``."""
    return F.max(as_col(x)).over(w.rangeBetween(-n, -n))


def change_days(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    """Change over exactly ``n`` days, NULL where the earlier day has no row."""
    return as_col(x) - shift_days(x, n, w)


def last_known(x: ColumnOrName, n: int, w: WindowSpec) -> Column:
    """The last present value that is at least ``n`` days old."""
    return F.last(as_col(x), ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -n))
