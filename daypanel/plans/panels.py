"""Pipelines from landed inputs to enriched panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from daypanel.functions.dates import serial_date
from daypanel.functions.missing import fill_zero, not_in_set
from daypanel.functions.text import strip_chars
from daypanel.operators.joins import join_natural, join_null_safe
from daypanel.operators.metrics import PanelSpec, enrich_panel
from daypanel.operators.reshape import q, quoted
from daypanel.sources.files import header_date, range_to_long

# Id columns of a wide country file and the join key of the three files.
COUNTRY_IDS = ("Province/State", "Country/Region", "Lat", "Long")
COUNTRY_KEY = ("Province/State", "Country/Region", "date")
# Total rows of the hand-made tables.
DISTRICT_TOTALS = ("Summe", "Stadt")


def join_measures(conf: DataFrame, dea: DataFrame, rec: DataFrame, natural: bool = False) -> DataFrame:
    """Long panels (ids, date, conf | dea | rec) side by side; a missing province matches a missing province.

    By default the key is province, country and date. ``natural=True`` also compares the coordinates, so a
    shifted coordinate finds no partner.
    """
    if natural:
        return join_natural(join_natural(conf, dea), rec)
    bare = [df.drop("Lat", "Long") for df in (dea, rec)]
    return join_null_safe(join_null_safe(conf, bare[0], COUNTRY_KEY), bare[1], COUNTRY_KEY)


def join_wide(conf: DataFrame, dea: DataFrame, rec: DataFrame, natural: bool = False) -> DataFrame:
    """Three wide files as (ids, date, conf, dea, rec): joined with one row per province, then unpivoted once.

    The keys are those of ``join_measures``. The days are those of the first file; a day that another file
    lacks is missing there.
    """
    ids = conf.columns[: len(COUNTRY_IDS)]
    keys = ids if natural else ids[:2]
    wide = conf.select(*[q(c) for c in ids], *[q(c).alias(f"conf {c}") for c in conf.columns[len(ids) :]])
    for name, df in (("dea", dea), ("rec", rec)):
        days = df.columns[len(ids) :]
        right = df.select(*[q(c).alias(f"_{c}") for c in keys], *[q(c).alias(f"{name} {c}") for c in days])
        same = [wide[quoted(c)].eqNullSafe(right[quoted(f"_{c}")]) for c in keys]
        wide = wide.join(right, same, "left").drop(*[f"_{c}" for c in keys])
    measures = {"conf": conf, "dea": dea, "rec": rec}
    dated = {n: {header_date(c): c for c in df.columns[len(ids) :]} for n, df in measures.items()}
    cells = []
    for day in dated["conf"]:
        shown = f"DATE'{day.isoformat()}'" if day else "CAST(NULL AS DATE)"
        values = [
            f"try_cast({quoted(f'{n} {dated[n][day]}')} AS DOUBLE) AS {n}" if day in dated[n] else f"CAST(NULL AS DOUBLE) AS {n}" for n in measures
        ]
        cells.append(f"struct({shown} AS date, {', '.join(values)})")
    return wide.selectExpr(*[quoted(c) for c in ids], f"inline(array({', '.join(cells)}))")


def country_panel(conf: DataFrame, dea: DataFrame, rec: DataFrame, natural: bool = False) -> DataFrame:
    """Three wide country files to the enriched country panel."""
    return enrich_panel(join_wide(conf, dea, rec, natural), PanelSpec(region="Country/Region"))


def district_long(conf_rows: DataFrame, dea_rows: DataFrame, totals: Sequence[str] = DISTRICT_TOTALS) -> DataFrame:
    """Two sheet ranges with serial-number date headers to (district, date, conf, dea), blanks as zero."""
    conf, dea = [
        range_to_long(rows, "district", "serial", name)
        .select("district", serial_date("serial").alias("date"), name)
        for rows, name in ((conf_rows, "conf"), (dea_rows, "dea"))
    ]
    return (
        join_natural(conf, dea)
        .withColumns({"conf": fill_zero("conf"), "dea": fill_zero("dea")})
        .where(not_in_set("district", totals))
    )


def district_panel(long: DataFrame, district: str = "district") -> DataFrame:
    """Two-measure district panel with all metrics, also the count of the last seven rows."""
    return enrich_panel(long, PanelSpec(region=district, rec=None))


def clean_snapshots(rows: DataFrame, district: str) -> DataFrame:
    """Snapshot rows with hyphens and spaces removed from the district name, exact duplicates dropped."""
    return rows.withColumn(district, strip_chars(q(district), "- ")).distinct()
