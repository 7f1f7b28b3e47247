"""Report tables: the data behind each chart and table, one DataFrame per view."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from daypanel.functions.dates import timestamp_ymd_hms
from daypanel.functions.missing import cut_right, sum_or_zero, try_div
from daypanel.functions.text import daily_per_100, implied_thousands, num, repair_thousands, replace_first
from daypanel.operators.filters import exclude_cells, matching, positive, same_weekday, two_snapshots, within
from daypanel.operators.joins import keep_listed
from daypanel.operators.loess import loess_fit
from daypanel.operators.metrics import (
    CHANGE_LABELS,
    RECOVERY_LABELS,
    TOTAL_LABELS,
    estimators_long,
    mean_fatality,
    recovery_estimate,
)
from daypanel.operators.projection import exponential_fan, recurrent_fan
from daypanel.operators.reshape import map_columns, pivot_declared, q, union_tagged, unpivot_some, with_label
from daypanel.operators.select import global_row_number, pick_regions, top_n_per
from daypanel.operators.stats import box_stats, order_by_aggregate, trend_class
from daypanel.operators.windows import lead_growth, rate_per_previous, series
from daypanel.sources.json_items import items_by_title

# Breaks of the incidence bands; weeks-long trajectory lengths in days.
INCIDENCE_BREAKS = (0, 500, 750, 1500)
TRAJECTORY_DAYS = 42
# Published headings of the current table.
CURRENT_HEADINGS = {
    "conf_total": "Bestätigte_Gesamt",
    "dea_total": "Gestorben_Gesamt",
    "rec_total": "Genesen_Gesamt",
    "conf_day": "Bestätigte_Tag",
    "dea_day": "Gestorben_Tag",
    "rec_day": "Genesen_Tag",
    "dea_per_conf": "Tote_pro_Bestätigte",
    "dea_per_closed": "Tote_pro_Abgeschlossene",
    "adv_estimator": "Adv_Estimator_2",
    "doubling_days": "Verdopplungszeit",
}


def _measures(panel: DataFrame, labels: dict[str, str]) -> DataFrame:
    cols = [c for c in labels if c in panel.columns]
    long = unpivot_some(panel, cols, "measure", "value", keep=["region", "date"])
    return with_label(long, "measure", labels)


def totals(panel: DataFrame, regions: DataFrame) -> DataFrame:
    return _measures(keep_listed(panel, regions, "region"), TOTAL_LABELS)


def daily_changes(panel: DataFrame, regions: DataFrame | None = None, outliers: Iterable = ()) -> DataFrame:
    rows = panel if regions is None else keep_listed(panel, regions, "region")
    return _measures(exclude_cells(rows.drop("active_1"), outliers), CHANGE_LABELS)


def active_changes(panel: DataFrame, regions: DataFrame, outliers: Iterable = ()) -> DataFrame:
    rows = exclude_cells(keep_listed(panel, regions, "region"), outliers)
    return rows.select("region", "date", F.col("active_1").alias("value"))


def growth_smoothed(panel: DataFrame, regions: DataFrame | None = None, span: float = 0.5) -> DataFrame:
    """Growth to the next day with its smooth; rates outside 0..1 are dropped before smoothing."""
    rows = panel if regions is None else keep_listed(panel, regions, "region")
    rates = rows.select("region", "date", lead_growth("conf", series()).alias("g"))
    return loess_fit(within(rates, "g", 0, 1), "region", "date", "g", span)


def rate_smoothed(panel: DataFrame, regions: DataFrame | None = None, span: float = 0.2) -> DataFrame:
    """New cases per previously active case with its smooth."""
    rows = panel if regions is None else keep_listed(panel, regions, "region")
    rates = rows.select("region", "date", rate_per_previous("conf_1", "active", series()).alias("g"))
    return loess_fit(rates.where(F.col("g").isNotNull()), "region", "date", "g", span)


def estimators(panel: DataFrame, regions: DataFrame) -> DataFrame:
    return estimators_long(keep_listed(panel, regions, "region")).select(
        "region", "date", "estimator", "value", "est_quality"
    )


def _current_columns(rows: DataFrame) -> DataFrame:
    has_rec = "rec" in rows.columns
    cols = [F.col("conf").alias("conf_total"), F.col("dea").alias("dea_total")]
    cols += [F.col("rec").alias("rec_total")] if has_rec else []
    cols += [F.col("conf_1").alias("conf_day"), F.col("dea_1").alias("dea_day")]
    cols += [F.col("rec_1").alias("rec_day")] if has_rec else []
    cols += [F.round("cfr_1", 3).alias("dea_per_conf")]
    cols += [F.round("cfr_2", 3).alias("dea_per_closed")] if has_rec else []
    cols += [F.round("cfr_adv", 3).alias("adv_estimator"), F.round("doubling", 1).alias("doubling_days")]
    return rows.select(*[c for c in ("ordinal", "region", "date") if c in rows.columns], *cols)


def current_table(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per listed region: its last day, rounded. Order by ``conf_total`` for display.

    The list is applied first: it picks whole regions, so their last day is the same.
    """
    return _current_columns(top_n_per(keep_listed(panel, regions, "region"), "region", 1, "date"))


def with_headings(table: DataFrame) -> DataFrame:
    return table.withColumnsRenamed({k: v for k, v in CURRENT_HEADINGS.items() if k in table.columns})


def trajectory(panel: DataFrame, regions: DataFrame, as_of: dt.date, days: int = TRAJECTORY_DAYS) -> DataFrame:
    """Last days of each listed region, sampled on the weekday before the report day."""
    recent = top_n_per(keep_listed(panel, regions, "region"), "region", days, "date")
    return same_weekday(_current_columns(recent), as_of)


def trajectory_last(points: DataFrame) -> DataFrame:
    return top_n_per(points, "region", 1, "date")


def trajectory_drawn(points: DataFrame) -> DataFrame:
    """Points a logarithmic doubling-time axis shows."""
    return positive(points, "doubling_days")


def weekday_box(panel: DataFrame, regions: DataFrame, outliers: Iterable = ()) -> DataFrame:
    """Box-plot statistics of the positive daily counts per region and weekday."""
    rows = exclude_cells(keep_listed(panel, regions, "region"), outliers).where(F.col("conf_1") > 0)
    # The days of a region are bounded by the calendar.
    return box_stats(rows, ["region", "weekday"], "conf_1", spread=False)


def scenario_totals(panel: DataFrame) -> DataFrame:
    return exponential_fan(panel, "conf")


def scenario_active(panel: DataFrame) -> DataFrame:
    return recurrent_fan(panel, "active", "conf_1")


def recovery(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """Totals with estimated recoveries for the listed regions, long by measure."""
    listed = keep_listed(panel, regions, "region")
    estimated = recovery_estimate(listed, mean_fatality(top_n_per(listed, "region", 1, "date")))
    return _measures(estimated, RECOVERY_LABELS)


def incidence_ranking(rows: DataFrame, name: str, count: str, new: str, per_100k: str) -> DataFrame:
    """Scraped text cells to numbers, implied inhabitants, daily rate, and the order by incidence."""
    numbers = rows.select(q(name).alias("name"), *[num(q(c)).alias(a) for c, a in ((count, "count"), (new, "new"), (per_100k, "per_100k"))])
    derived = numbers.withColumn("inhabitants_thousands", implied_thousands("count", "per_100k")).withColumn(
        "new_per_100", daily_per_100("new", "inhabitants_thousands")
    )
    by_incidence = order_by_aggregate(derived, "name", "per_100k", "max", "ord")
    by_change = order_by_aggregate(derived, "name", "new_per_100", "max", "ord_change")
    return derived.join(by_incidence.drop("level"), "name").join(by_change.drop("level"), "name")


def snapshot_change(
    rows: DataFrame, district: str, value: str, as_of: dt.date, total: str = "Gesamtergebnis", stamp: str = "update"
) -> DataFrame:
    """Values of the report day and a week earlier per district, districts ordered by their median."""
    picked = two_snapshots(rows.where(q(district) != total), as_of, stamp).select(
        q(district).alias("district"), q(stamp).alias("stamp"), q(value).alias("value")
    )
    return picked.join(order_by_aggregate(picked, "district", "value", "median", spread=False).drop("level"), "district")


def timeline(
    rows: DataFrame, district: str, value: str, total: str | None = "Gesamtergebnis", pattern: str | None = None,
    stamp: str = "update",
) -> DataFrame:
    """District series over all snapshots, distinct, optionally one name pattern."""
    out = rows if total is None else rows.where(q(district) != total)
    out = out if pattern is None else matching(out, q(district), pattern)
    return out.select(q(district).alias("district"), q(stamp).alias("stamp"), q(value).alias("value")).distinct()


def district_trend(panel: DataFrame, n: int = 10) -> DataFrame:
    """Trend class of the count of the last seven rows, on the last ``n`` rows of each district."""
    return trend_class(panel, "region", "date", "last_7", n)


def snapshot_trend(rows: DataFrame, district: str, y: str, stamp: str = "update", n: int = 10) -> DataFrame:
    """Trend class per district over the last ``n`` snapshots; total rows are left out.

    Repeated rows count once, and of rows with equal stamps the higher values are the later ones.
    """
    kept = matching(rows.distinct(), q(district), "esamt", keep=False)
    return trend_class(kept, district, stamp, y, n, tie=y)


def district_extremes(panel: DataFrame, k: int = 10, largest: bool = True) -> DataFrame:
    """Totals of the top or bottom districts, long by measure."""
    return totals(panel, pick_regions(panel, k, "conf", largest=largest))


def district_table(panel: DataFrame, k: int = 10) -> DataFrame:
    """Last day of the top and bottom districts with their position among all districts."""
    last_day = top_n_per(panel, "region", 1, "date")
    numbered = global_row_number(last_day, "conf", "region", "ordinal", descending=True)
    top = pick_regions(panel, k, "conf")
    bottom = pick_regions(panel, k, "conf", largest=False)
    return _current_columns(keep_listed(numbered, top.unionByName(bottom), "region"))


def age_sex_ratio(
    tested: DataFrame, death: DataFrame, band: str, sexes: Sequence[str], unknown_sex: str, unknown_band: str
) -> DataFrame:
    """Deaths per tested person by age band and sex, from two wide tables with damaged thousands."""
    both = union_tagged({"tested": tested, "death": death})
    repaired = map_columns(both, repair_thousands, cols=sexes)
    long = unpivot_some(matching(repaired, q(band), "esamt", keep=False), sexes, "sex", "count")
    wide = pivot_declared(long, [band, "sex"], "source", "count", ["tested", "death"])
    return (
        wide.where((F.col("sex") != unknown_sex) & (q(band) != unknown_band))
        .withColumn("ratio", try_div("death", "tested"))
        .select(q(band).alias("band"), "sex", "tested", "death", "ratio")
    )


def band_ratio(
    rows: DataFrame, count: str, deaths: str, incidence: str, breaks: Sequence[float] = INCIDENCE_BREAKS
) -> DataFrame:
    """Deaths per case by incidence band; districts outside the breaks form a band of their own (NULL)."""
    numbers = rows.select(
        num(replace_first(q(incidence), ",", ".")).alias("per_100k"),
        num(replace_first(q(deaths), "-", "0")).alias("deaths"),
        repair_thousands(q(count)).alias("cases"),
    ).withColumn("band", cut_right("per_100k", breaks))
    return numbers.groupBy("band").agg(
        F.count(F.lit(1)).alias("districts"), try_div(sum_or_zero("deaths"), sum_or_zero("cases")).alias("ratio")
    )


def page_views(responses: DataFrame, titles: DataFrame) -> DataFrame:
    return items_by_title(responses, titles).select("article", "day", "views")


def freshness(rows: DataFrame, stamp: str) -> DataFrame:
    return rows.agg(F.max(q(stamp)).alias("updated"))


def dashboard_snapshot(rows: DataFrame, district: str, stamp: str, total: str = "gesamt") -> DataFrame:
    """The districts of the latest snapshot of a prepared file, its stamps given as text, each with its share of the total row.

    Adds ``updated``, the time of that snapshot. A snapshot without a total row has missing shares.
    """
    timed = rows.withColumn(stamp, timestamp_ymd_hms(q(stamp))).distinct()
    last = timed.where(q(stamp) == timed.agg(F.max(q(stamp))).scalar())
    sums = last.where(q(district) == total).agg(F.max("cumulated").alias("_total")).scalar()
    kept = last.where(q(district) != total).withColumnRenamed(stamp, "updated")
    return kept.withColumn("share", try_div("cumulated", sums))
