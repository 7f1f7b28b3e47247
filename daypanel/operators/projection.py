"""Scenario projections and the comparison with intensive-care capacity, for any number of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from daypanel.functions.missing import ColumnOrName, as_col, clamp_below, round_even
from daypanel.operators.reshape import union_fill
from daypanel.operators.select import last_rows

# Growth rates of scenarios 1 to 3, horizon in days, beds, share of cases in intensive care.
RATES = (0.15, 0.10, 0.05)
HORIZON = 50
BEDS = 820 * 34
EXTRA_BEDS = 10000
CARE_SHARE = 0.05
# The recurrence subtracts the new cases of the 13th row before the new one.
DELAY_ROWS = 13


def care_need(cases: ColumnOrName, share: float = CARE_SHARE) -> Column:
    return round_even(as_col(cases) * share)


def with_capacity(df: DataFrame, beds: int = BEDS, extra: int = EXTRA_BEDS) -> DataFrame:
    return df.withColumns({"capacity": F.lit(beds), "capacity_extended": F.lit(beds + extra)})


def _scenarios(rates: Sequence[float]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(i).alias("scenario"), F.lit(float(r)).alias("rate")) for i, r in enumerate(rates, 1)])
    )


def _observed(panel: DataFrame, value: str, rates: Sequence[float]) -> DataFrame:
    return panel.select("region", "date", F.col(value).alias("value"), _scenarios(rates).alias("s")).select(
        "region", "date", F.lit("Beobachtung").alias("status"), "s.scenario", "s.rate", "value"
    )


def _report(rows: DataFrame) -> DataFrame:
    return with_capacity(rows.withColumn("need", care_need("value")))


def exponential_fan(
    panel: DataFrame, value: str = "conf", rates: Sequence[float] = RATES, horizon: int = HORIZON
) -> DataFrame:
    """Observed rows plus ``max * (1 + rate)^i`` for the days after the last one, long by scenario.

    Scenario and day come from generators over a bounded list, so nothing is joined.
    """
    start = panel.groupBy("region").agg(F.max("date").alias("last"), F.max(value).alias("top"))
    ahead = (
        start.select("region", "last", "top", _scenarios(rates).alias("s"))
        .select("region", "last", "top", "s.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
        .select(
            "region",
            F.date_add("last", F.col("i")).alias("date"),
            F.lit("Prognose").alias("status"),
            "scenario",
            "rate",
            (F.col("top") * F.pow(1 + F.col("rate"), F.col("i").cast("double"))).alias("value"),
        )
    )
    return _report(union_fill(_observed(panel, value, rates), ahead))


def recurrent_steps(
    panel: DataFrame,
    stock: str = "active",
    new: str = "conf_1",
    rates: Sequence[float] = RATES,
    horizon: int = HORIZON,
) -> DataFrame:
    """Forecast rows of the recurrence with recovery delay; series with fewer than 13 rows have none.

    Each step: stock' = max(stock * (1 + rate) - new cases 13 rows before, 0) and new' = stock * rate.
    A series sends only its last 13 rows to the shuffle, and the fold over the horizon keeps 13 values.
    """
    history = (
        last_rows(panel.select("region", "date", stock, new), "region", DELAY_ROWS, "date")
        .groupBy("region")
        .agg(F.array_sort(F.collect_list(F.struct("date", F.col(stock).alias("a"), F.col(new).alias("c")))).alias("h"))
        .where(F.size("h") == DELAY_ROWS)
        .select(
            "region",
            F.col("h")[DELAY_ROWS - 1]["date"].alias("last"),
            F.col("h")[DELAY_ROWS - 1]["a"].cast("double").alias("a"),
            F.transform("h", lambda r: r["c"].cast("double")).alias("c"),
            _scenarios(rates).alias("s"),
        )
        .select("region", "last", "a", "c", "s.*")
    )
    step_type = "array<struct<i:int,active:double,new:double>>"
    start = F.struct(F.col("a").alias("a"), F.col("c").alias("c"), F.array().cast(step_type).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        a = clamp_below(acc["a"] * (1 + F.col("rate")) - acc["c"][0], 0)
        c = acc["a"] * F.col("rate")
        row = F.struct(i.alias("i"), a.alias("active"), c.alias("new"))
        return F.struct(
            a.alias("a"),
            F.concat(F.slice(acc["c"], 2, DELAY_ROWS - 1), F.array(c)).alias("c"),
            F.array_append(acc["out"], row).cast(step_type).alias("out"),
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda acc: acc["out"])
    return (
        history.select("region", "last", "scenario", "rate", F.inline(folded))
        .select("region", F.date_add("last", F.col("i")).alias("date"), "scenario", "rate", "i", "active", "new")
    )


def recurrent_fan(
    panel: DataFrame,
    stock: str = "active",
    new: str = "conf_1",
    rates: Sequence[float] = RATES,
    horizon: int = HORIZON,
) -> DataFrame:
    """Observed rows plus the recurrent forecast, long by scenario, with need and capacity."""
    ahead = recurrent_steps(panel, stock, new, rates, horizon).select(
        "region", "date", F.lit("Prognose").alias("status"), "scenario", "rate", F.col("active").alias("value")
    )
    return _report(union_fill(_observed(panel, stock, rates), ahead))
