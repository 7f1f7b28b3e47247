"""Linear trends, box-plot statistics and category orders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from daypanel.functions.missing import cut_right
from daypanel.operators.blocks import placed
from daypanel.operators.reshape import q
from daypanel.operators.select import global_row_number, last_rows
from daypanel.operators.windows import row_index

# Breaks of the trend classes and their German labels.
TREND_BREAKS = (-10, -1, 1, 10)
TREND_LABELS = ("sinkend", "gleichbleibend", "steigend")


def linear_fit(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """Least-squares line per group on every detail row; NULL for groups with fewer than two points.

    A window over the group, for groups that a last-n frame bounds; ``linear_fit_summary`` is for any others.
    """
    group = Window.partitionBy(q(key))
    enough = F.regr_count(q(y), q(x)).over(group) >= 2
    return df.withColumns(
        {
            "intercept": F.when(enough, F.regr_intercept(q(y), q(x)).over(group)),
            "slope": F.when(enough, F.regr_slope(q(y), q(x)).over(group)),
        }
    )


def linear_fit_summary(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """One row per group with intercept and slope, combined map-side: no window over the group."""
    enough = F.regr_count(q(y), q(x)) >= 2
    return df.groupBy(q(key)).agg(
        F.when(enough, F.regr_intercept(q(y), q(x))).alias("intercept"),
        F.when(enough, F.regr_slope(q(y), q(x))).alias("slope"),
    )


def trend_class(
    df: DataFrame,
    key: str,
    order: str,
    y: str,
    n: int = 10,
    breaks: Sequence[float] = TREND_BREAKS,
    labels: Sequence[str] = TREND_LABELS,
    tie: str | None = None,
) -> DataFrame:
    """Slope over the last ``n`` rows of each group, classed falling, flat or rising.

    Only the last ``n`` rows of a group leave the map side. A slope beyond the outer breaks has no class.
    The slope is rounded to nine digits before classing, so that rounding noise crosses no break.
    """
    recent = last_rows(df, key, n, order, tie)
    steps = Window.partitionBy(q(key)).orderBy(q(order), *([q(tie)] if tie else []))
    fitted = linear_fit(recent.withColumn("step", row_index(steps)), key, y, "step")
    return fitted.withColumn("trend", cut_right(F.round("slope", 9), breaks, labels))


def quantiles(df: DataFrame, keys: Sequence[str], y: str, shares: Mapping[str, float], spread: bool = True) -> DataFrame:
    """Exact quantiles of each group, one column per name of ``shares``, with the number of values as ``n``.

    The value between the two neighbours of a quantile is interpolated; missing values do not count. Equal values
    of a group are counted first, the different ones are range-partitioned by (group, value), and the counts of the partitions
    tell which rows are neighbours: a group with half of all rows spreads over all tasks. For groups that the
    calendar bounds, such as the days of a region, ``spread=False`` sorts each in a task, with fewer jobs.
    """
    names, value = [q(k) for k in keys], q(y).cast("double").alias("_y")
    rows = df.where(q(y).isNotNull())
    if spread:
        placing = placed(rows.groupBy(*names, value).agg(F.count(F.lit(1)).alias("_w")), keys, ["_y"], weight="_w")
        places = placing.select(*names, "_y", F.col("_pos").alias("_first"), (F.col("_pos") + F.col("_w") - 1).alias("_last"), F.col("_n").alias("n"))
    else:
        group = Window.partitionBy(*names)
        place = F.row_number().over(group.orderBy(q(y))) - 1
        places = rows.select(*names, value, place.alias("_first"), place.alias("_last"), F.count(F.lit(1)).over(group).alias("n"))
    out, needed = [], F.lit(False)
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(float(share))
        low = F.floor(at)
        hits = [i.between(F.col("_first"), F.col("_last")) for i in (low, F.least(low + 1, F.col("n") - 1))]
        below, above = (F.max(F.when(hit, F.col("_y"))) for hit in hits)
        needed = needed | hits[0] | hits[1]
        out.append((below + (above - below) * F.max(at - low)).alias(name))
    return places.where(needed).groupBy(*names, "n").agg(*out)


def box_outliers(df: DataFrame, keys: Sequence[str], y: str, spread: bool = True) -> DataFrame:
    """The values beyond 1.5 interquartile ranges, one row each: keys and ``y``."""
    return _boxed(df, keys, y, spread).where(~F.col("_inside")).select(*[q(k) for k in keys], q(y))


def _boxed(df: DataFrame, keys: Sequence[str], y: str, spread: bool) -> DataFrame:
    quartiles = quantiles(df, keys, y, {"q1": 0.25, "median": 0.5, "q3": 0.75}, spread)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = q(y).between(F.col("q1") - reach, F.col("q3") + reach)
    return df.where(q(y).isNotNull()).join(quartiles, list(keys)).withColumn("_inside", inside)


def box_stats(df: DataFrame, keys: Sequence[str], y: str, spread: bool = True) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the sorted outliers of each group for display.

    The array of outliers is for groups that are drawn, such as panel rows, which the calendar bounds;
    ``box_outliers`` gives them as rows.
    """
    return (
        _boxed(df, keys, y, spread)
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("_inside"), q(y))).alias("whisker_low"),
            F.max(F.when(F.col("_inside"), q(y))).alias("whisker_high"),
            F.array_sort(F.collect_list(F.when(~F.col("_inside"), q(y)))).alias("outliers"),
        )
    )


def order_by_aggregate(
    df: DataFrame, category: str, x: str, how: str = "median", out: str = "ord", spread: bool = True
) -> DataFrame:
    """One row per category with its position when categories are ordered by median or maximum of ``x``."""
    if how == "median":
        levels = quantiles(df, [category], x, {"level": 0.5}, spread).drop("n")
        # A category without values has a missing level.
        levels = df.select(q(category)).distinct().join(levels, category, "left")
    else:
        levels = df.groupBy(q(category)).agg(F.max(q(x)).alias("level"))
    return global_row_number(levels, "level", category, out)
