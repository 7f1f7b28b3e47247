"""Metrics of a region-by-day panel: changes, fatality ratios, active cases, doubling time, recovery estimate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from daypanel.functions.dates import weekday_label
from daypanel.functions.missing import cumsum_strict, doubling_time, flag_above, sum_strict, try_div
from daypanel.operators.blocks import BLOCK_ROWS, Blocks
from daypanel.operators.reshape import unpivot_some
from daypanel.operators.windows import change, series, shift, shifted_change

# Measure and estimator names with their German display labels.
TOTAL_LABELS = {"conf": "Bestätigt", "dea": "Gestorben", "rec": "Genesen", "active": "Krank"}
CHANGE_LABELS = {"conf_1": "Bestätigt", "dea_1": "Gestorben", "rec_1": "Genesen", "active_1": "Krank"}
RECOVERY_LABELS = {
    "conf": "Bestätigt",
    "dea": "Gestorben",
    "rec_est_total": "Genesen Prognose",
    "active_est": "Aktuell Krank Prognose",
}
ESTIMATOR_LABELS = {
    "cfr_1": "Tote pro Bestätigte Fälle",
    "cfr_2": "Tote pro Abgeschlossene Fälle",
    "cfr_adv": "Advanced Estimator",
}


@dataclass(frozen=True)
class PanelSpec:
    """Column names of a panel and the delay constants, in rows. ``rec=None`` is a two-measure panel."""

    region: str = "region"
    date: str = "date"
    conf: str = "conf"
    dea: str = "dea"
    rec: str | None = "rec"
    recovery_rows: int = 20
    death_rows: int = 7
    alternative_rows: int = 10
    quality_deaths: float = 20


def aggregate_panel(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Sum sub-regions to one row per region and day; one missing part makes the total missing."""
    measures = {"conf": spec.conf, "dea": spec.dea} | ({"rec": spec.rec} if spec.rec else {})
    return df.groupBy(F.col(spec.region).alias("region"), F.col(spec.date).alias("date")).agg(
        *[sum_strict(F.col(src).cast("double")).alias(name) for name, src in measures.items()]
    )


def enrich_panel(df: DataFrame, spec: PanelSpec = PanelSpec(), weekday_mode: str = "true") -> DataFrame:
    """Aggregate a panel and add all metrics.

    Two shuffles: the map-side combined sum by (region, date), then the windows by region. All windows
    share one partitioning and one sort; every offset reads the totals directly, so two window levels do.
    """
    return add_metrics(aggregate_panel(df, spec), spec, weekday_mode)


def _base(spec: PanelSpec, weekday_mode: str) -> dict[str, Column]:
    """Metrics of a row by itself."""
    out = {"cfr_1": try_div("dea", "conf"), "weekday": weekday_label("date", weekday_mode)}
    if spec.rec is not None:
        out["cfr_2"] = try_div("dea", F.col("dea") + F.col("rec"))
        out["active"] = F.col("conf") - F.col("dea") - F.col("rec")
    return out


def _offsets(spec: PanelSpec, w: WindowSpec) -> dict[str, Column]:
    """Metrics that look some rows back."""
    out = {
        "dea_1": change("dea", w),
        "conf_1": change("conf", w),
        "dea_1_shift": shifted_change("dea", spec.recovery_rows - spec.death_rows, w),
        "conf_1_shift": shifted_change("conf", spec.death_rows, w),
        "conf_1_shift_alt": shifted_change("conf", spec.alternative_rows, w),
        "doubling": doubling_time(try_div("conf", shift("conf", 3, w, None))),
        "last_7": change("conf", w, 7),
    }
    if spec.rec is not None:
        out["rec_1"] = change("rec", w)
        out["active_1"] = change("active", w)
    return out


#: Running sums behind the adjusted ratio.
_RUNNING = {"_deaths": "dea_1", "_cases": "conf_1_shift"}


def _derived(spec: PanelSpec) -> dict[str, Column]:
    return {
        "cfr_adv": try_div("_deaths", "_cases"),
        "est_quality": flag_above("_deaths", spec.quality_deaths, "mittel", "gering"),
    }


def add_metrics(panel: DataFrame, spec: PanelSpec = PanelSpec(), weekday_mode: str = "true") -> DataFrame:
    """Metrics of a panel that already has one row per (region, date) and the standard column names."""
    w = series()
    running = {name: cumsum_strict(x, w) for name, x in _RUNNING.items()}
    metrics = panel.withColumns(_base(spec, weekday_mode)).withColumns(_offsets(spec, w)).withColumns(running).withColumns(_derived(spec))
    return metrics.drop(*_RUNNING)


def add_metrics_blocked(panel: DataFrame, spec: PanelSpec = PanelSpec(), weekday_mode: str = "true", size: int = BLOCK_ROWS) -> DataFrame:
    """The same metrics for series of any length, such as counts by the second: a region spreads over many tasks."""
    reach = max(7, spec.recovery_rows - spec.death_rows + 1, spec.death_rows + 1, spec.alternative_rows + 1)
    blocks = Blocks.of(panel.withColumns(_base(spec, weekday_mode)), "region", "date", size)
    blocks = blocks.with_offsets(lambda w: _offsets(spec, w), back=reach).with_running(_RUNNING)
    return blocks.with_columns(_derived(spec)).frame().drop(*_RUNNING)


def estimators_long(panel: DataFrame) -> DataFrame:
    """One row per region, day and fatality estimator. Keep the panel wide elsewhere: this triples it."""
    cols = [c for c in ESTIMATOR_LABELS if c in panel.columns]
    return unpivot_some(panel, cols, "estimator", "value")


def mean_fatality(last_day: DataFrame) -> DataFrame:
    """Per region the mean of the crude and the delay-adjusted ratio, both rounded to three digits."""
    mean = (F.round("cfr_1", 3) + F.round("cfr_adv", 3)) / 2
    return last_day.select("region", mean.alias("cfr_mean"))


def recovery_estimate(panel: DataFrame, fatality: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Estimated recoveries: the surviving share of the new cases of 20 rows earlier, cumulated."""
    w = series()
    return (
        panel.join(fatality, "region")
        .withColumn("rec_est", (1 - F.col("cfr_mean")) * shift("conf_1", spec.recovery_rows, w))
        .withColumn("rec_est_total", cumsum_strict("rec_est", w))
        .withColumn("active_est", F.col("conf") - F.col("dea") - F.col("rec_est_total"))
    )
