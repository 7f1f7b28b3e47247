"""Panels derived from the given tables. Raw rows are always summed per key and day first, combined map-side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from daypanel.operators.metrics import PanelSpec, enrich_panel
from daypanel.operators.reshape import pivot_declared
from daypanel.session import stage

AS_OF = dt.date(2024, 1, 31)
MANUAL = ("C1", "C2")
OUTLIERS = ((("C3"), dt.date(2024, 1, 13)),)


# The columns of the given tables, so that no footer is read to infer them.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def user_days(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts per user and day without gaps: (user_id, date, conf, dea, rec).

    Each counted day is spread forward to the day before the next counted one, so no grid is joined; the
    first also reaches back to the first day of the table with zero counts.
    """
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"), "event_type")
    ends = events.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    daily = events.groupBy("user_id", "date").agg(
        F.count(F.lit(1)).alias("conf"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("dea"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("rec"),
    )
    w = Window.partitionBy("user_id").orderBy("date")
    running = daily.select(
        "user_id",
        "date",
        *[F.sum(c).over(w).cast("double").alias(c) for c in ("conf", "dea", "rec")],
        F.lead("date").over(w).alias("next"),
        F.row_number().over(w).alias("n"),
        lo.alias("lo"),
        hi.alias("hi"),
    )

    def span(first, last, counted):
        return F.struct(first.alias("a"), last.alias("b"), F.lit(counted).alias("counted"))

    own = span(F.col("date"), F.coalesce(F.date_sub("next", 1), F.col("hi")), 1.0)
    before = span(F.col("lo"), F.date_sub("date", 1), 0.0)
    late = (F.col("n") == 1) & (F.col("date") > F.col("lo"))
    spans = F.when(late, F.array(before, own)).otherwise(F.array(own))
    counts = ("conf", "dea", "rec")
    return running.select("user_id", *counts, F.inline(spans)).select(
        "user_id",
        F.explode(F.sequence("a", "b")).alias("date"),
        *[(F.col(c) * F.col("counted")).alias(c) for c in counts],
    )


def _ids(df: DataFrame, *measures: str) -> DataFrame:
    """Ids of a country panel; the province is missing for users below 25."""
    user = F.col("user_id")
    return df.select(
        F.when(user >= 25, F.concat(F.lit("P"), user)).alias("Province/State"),
        F.concat(F.lit("C"), user % 25).alias("Country/Region"),
        (user % 90).cast("double").alias("Lat"),
        (user % 180).cast("double").alias("Long"),
        "date",
        *measures,
    )


def has_rec():
    """Users of one country are missing from the third measure."""
    return F.col("user_id") % 50 != 7


def country_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three long tables (ids, date, conf | dea | rec); the third lacks some users."""
    days = stage(user_days(spark, sf), "user-days")
    return _ids(days, "conf"), _ids(days, "dea"), _ids(days.where(has_rec()), "rec")


def country_long(spark: SparkSession, sf: str) -> DataFrame:
    """The three measures in one table, (region, province, date, conf, dea, rec): what joining the tables gives."""
    days = user_days(spark, sf).withColumn("rec", F.when(has_rec(), F.col("rec")))
    return _ids(days, "conf", "dea", "rec").withColumnsRenamed({"Country/Region": "region", "Province/State": "province"})


def day_range(spark: SparkSession, sf: str) -> list[dt.date]:
    """The days of the table: two values are fetched, to name the columns of a wide file."""
    lo, hi = table(spark, sf, "events").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return [lo + dt.timedelta(days=i) for i in range((hi - lo).days + 1)]


def mdy(day: dt.date) -> str:
    return f"{day.month}/{day.day}/{day:%y}"


def country_wide(spark: SparkSession, sf: str, measures: tuple[str, ...] = ("conf", "dea", "rec")) -> list[DataFrame]:
    """Wide files: one row per province, one column per day."""
    days = [mdy(d) for d in day_range(spark, sf)]
    ids = ["Province/State", "Country/Region", "Lat", "Long"]
    out = []
    for name, long in zip(("conf", "dea", "rec"), country_tables(spark, sf)):
        if name in measures:
            out.append(pivot_declared(long.withColumn("date", F.date_format("date", "M/d/yy")), ids, "date", name, days))
    return out


def country_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_panel(country_long(spark, sf))


def district_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders per nation and month as running totals (region, date, conf, dea).

    Orders are summed per customer and month before the join, so a customer with very many orders
    is no hot join key.
    """
    orders = table(spark, sf, "orders").select(
        "o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("date"), "o_orderstatus"
    )
    per_customer = orders.groupBy("o_custkey", "date").agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("d")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    monthly = (
        per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "date")
        .agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    w = Window.partitionBy("region").orderBy("date")
    return monthly.select(
        "region",
        "date",
        F.sum("c").over(w).cast("double").alias("conf"),
        F.sum("d").over(w).cast("double").alias("dea"),
    )


def district_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich_panel(district_counts(spark, sf), PanelSpec(rec=None))


# The columns of a district snapshot file.
DISTRICT = "Kreis/Stadt"
CUMULATED = "kumuliert bestätigte Fälle"
LAST_7 = "letzte 7 Tage bestätigte Fälle"
INCIDENCE = "letzte 7 Tage Inzidenz"
TOTAL = "Gesamtergebnis"
SNAPSHOT_SCHEMA = f"`{DISTRICT}` string, `{CUMULATED}` double, `{LAST_7}` double, `{INCIDENCE}` double, `update` timestamp_ntz"


def district_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """One row per district and snapshot, plus a total row per snapshot, as a scraped table has them."""
    w = Window.partitionBy("user_id").orderBy("date")
    days = user_days(spark, sf).select(
        "user_id", "date", "conf", (F.col("conf") - F.lag("conf", 7, 0.0).over(w)).alias("last7")
    )
    stamp = F.col("date").cast("timestamp_ntz") + F.expr("interval 9 hours")
    name = F.concat(F.lit("Kreis - "), F.col("user_id"))
    rows = days.select(name.alias("k"), "conf", "last7", stamp.alias("update"))
    total = days.groupBy("date").agg(F.sum("conf").alias("conf"), F.sum("last7").alias("last7"))
    both = rows.unionByName(total.select(F.lit(TOTAL).alias("k"), "conf", "last7", stamp.alias("update")))
    return both.select(
        F.col("k").alias(DISTRICT),
        F.col("conf").alias(CUMULATED),
        F.col("last7").alias(LAST_7),
        (F.col("last7") * 2.5).alias(INCIDENCE),
        "update",
    )
