"""All tables of a report from one panel, by name, and their publication."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

from daypanel.operators.select import pick_regions
from daypanel.plans import presets, reports
from daypanel.sources.sinks import publish_table


def country_views(
    panel: DataFrame,
    as_of: dt.date,
    manual: Iterable[str] = presets.REPORT_REGIONS,
    trajectory_manual: Iterable[str] = presets.TRAJECTORY_REGIONS,
    outliers: Iterable[tuple[str, dt.date]] = presets.OUTLIER_CELLS,
    k: int = 10,
) -> dict[str, DataFrame]:
    """The country report: every view of an enriched panel. Stage the panel first, all views read it."""
    outliers = tuple(outliers)
    listed = pick_regions(panel, k, manual=tuple(manual))
    trajectory = reports.trajectory(panel, pick_regions(panel, k, manual=tuple(trajectory_manual)), as_of)
    return {
        "totals": reports.totals(panel, listed),
        "daily_changes": reports.daily_changes(panel, listed, outliers),
        "active_changes": reports.active_changes(panel, listed, outliers),
        "growth": reports.growth_smoothed(panel, listed),
        "infection_rate": reports.rate_smoothed(panel, listed),
        "estimators": reports.estimators(panel, listed),
        "current": reports.current_table(panel, listed),
        "trajectory": trajectory,
        "trajectory_last": reports.trajectory_last(trajectory),
        "weekday_box": reports.weekday_box(panel, listed, outliers),
        "scenario_totals": reports.scenario_totals(panel),
        "scenario_active": reports.scenario_active(panel),
        "recovery": reports.recovery(panel, listed),
        "freshness": reports.freshness(panel, "date"),
    }


def district_views(panel: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The district report from a two-measure panel."""
    return {
        "district_top": reports.district_extremes(panel, k),
        "district_bottom": reports.district_extremes(panel, k, largest=False),
        "district_changes": reports.daily_changes(panel),
        "district_current": reports.district_table(panel, k),
        "district_trend": reports.district_trend(panel),
        "district_freshness": reports.freshness(panel, "date"),
    }


def snapshot_views(
    rows: DataFrame, district: str, count: str, incidence: str, as_of: dt.date, total: str = "Gesamtergebnis"
) -> dict[str, DataFrame]:
    """The views of cleaned district snapshots."""
    return {
        "snapshot_change": reports.snapshot_change(rows, district, incidence, as_of, total),
        "snapshot_timeline": reports.timeline(rows, district, incidence, total),
        "snapshot_trend": reports.snapshot_trend(rows, district, count),
        "snapshot_freshness": reports.freshness(rows, "update"),
    }


def publish(views: Mapping[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Register every view for SQL and, with a folder, store each as a table there."""
    return {name: publish_table(df, name, f"{folder}/{name}" if folder else None) for name, df in views.items()}
