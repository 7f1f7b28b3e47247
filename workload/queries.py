"""One query per operator and report, each over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from daypanel.functions import (
    add_days,
    clamp_below,
    cumsum_strict,
    cut_right,
    daily_per_100,
    date_mdy,
    date_ymd,
    date_yyyymmdd,
    doubling_time,
    fill_zero,
    flag_above,
    implied_thousands,
    not_in_set,
    num,
    num_comma,
    paste,
    repair_thousands,
    replace_first,
    round_even,
    serial_date,
    strip_chars,
    sum_or_zero,
    timestamp_ymd_hms,
    try_div,
    weekday_label,
)
from daypanel.operators import filters, gaps, joins, loess, metrics, projection, reshape, select, stats, windows
from daypanel.operators.blocks import Blocks
from daypanel.operators.reshape import q
from daypanel.plans import panels as pipelines, reports
from daypanel.session import scratch_dir, stage
from daypanel.sources import files, html, sinks
from daypanel.sources import json_items as json_items_module
from daypanel.streaming import ingest
from workload import panels as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Rounded copies of columns whose last bits differ between engines (logarithms, fits)."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def _en(spark: SparkSession, sf: str) -> DataFrame:
    return P.country_enriched(spark, sf)


def _staged(spark: SparkSession, sf: str) -> DataFrame:
    """The enriched panel, written once: for queries in which several branches use it."""
    return stage(_en(spark, sf), "panel")


def _districts(spark: SparkSession, sf: str) -> DataFrame:
    return stage(P.district_enriched(spark, sf), "districts")


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return stage(P.district_snapshots(spark, sf), "snapshots")


def _listed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    panel = _staged(spark, sf)
    return panel, select.pick_regions(panel, 10, manual=P.MANUAL)


def _plain(df: DataFrame) -> DataFrame:
    names = {
        "Province/State": "province", "Country/Region": "region", "Lat": "lat", "Long": "lon",
        P.DISTRICT: "district", P.CUMULATED: "cumulated", P.LAST_7: "last7", P.INCIDENCE: "incidence",
    }
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


# Sources and sinks


@query
def scan_wide_unpivot(spark, sf):
    path = scratch_dir(spark, "wide")
    P.country_wide(spark, sf, ("conf",))[0].write.option("header", True).csv(path)
    long = files.wide_to_long(files.read_wide(spark, path), 4, "conf")
    return _plain(long).select("province", "region", num("lat").alias("lat"), num("lon").alias("lon"), "date", "conf")


def _wide_folder(spark, sf):
    """Wide files as they come day by day: two files a day, each with a header of its own, one with the id columns last."""
    folder = scratch_dir(spark, "wide-folder")
    long = P.country_tables(spark, sf)[0]
    ids = ["Province/State", "Country/Region", "Lat", "Long"]
    kind = F.pmod(F.hash("Country/Region"), F.lit(2))
    key = F.concat(F.date_format("date", "yyyyMMdd-"), kind).alias("file")
    day = F.date_format("date", "M/d/yy")
    cells = [F.coalesce(q(c).cast("string"), F.lit("")) for c in ids]

    def line(own, day_cell):
        return F.when(kind == 0, F.concat_ws(",", *own, day_cell)).otherwise(F.concat_ws(",", day_cell, *own[::-1])).alias("value")

    heads = long.select(key, F.lit(0).alias("at"), line([F.lit(c) for c in ids], day)).distinct()
    body = long.select(key, F.lit(1).alias("at"), line(cells, F.col("conf").cast("string")))
    lines = heads.unionByName(body).repartition("file").sortWithinPartitions("file", "at")
    lines.select("file", "value").write.partitionBy("file").text(folder)
    return folder, ids


@query
def scan_wide_folder(spark, sf):
    """A folder of wide files with a new header every day."""
    folder, ids = _wide_folder(spark, sf)
    return _plain(files.read_wide_long(spark, folder, ids, "conf")).select(
        "province", "region", num("lat").alias("lat"), num("lon").alias("lon"), "date", "conf"
    )


def _snapshot_schema(spark):
    return spark.createDataFrame([], P.SNAPSHOT_SCHEMA).schema


@query
def scan_csv2(spark, sf):
    path = scratch_dir(spark, "csv2")
    rows = sinks.decimal_comma(P.district_snapshots(spark, sf))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return _plain(files.read_csv2(spark, path, _snapshot_schema(spark)))


def _snapshot_folder(spark, sf):
    """Daily files in which a third of the rows occur twice."""
    rows = P.district_snapshots(spark, sf)
    twice = rows.unionByName(rows.where(F.col(P.CUMULATED) % 3 == 0))
    return sinks.write_daily_csv2(twice, scratch_dir(spark, "snapshots"), "update")


@query
def scan_folder_distinct(spark, sf):
    rows = files.read_folder(spark, _snapshot_folder(spark, sf), _snapshot_schema(spark)).drop("file_name")
    cleaned = pipelines.clean_snapshots(rows, P.DISTRICT)
    return _plain(files.stamp(cleaned, dt.datetime(2024, 1, 31, 9), "loaded"))


def _sheets(spark, sf):
    """Two text workbooks, a sheet of thirty customers per file, with title lines and serial-number headers."""
    orders = P.table(spark, sf, "orders")
    cells = orders.groupBy("o_custkey", F.trunc(F.to_date("o_orderdate"), "quarter").alias("day")).agg(
        F.count(F.lit(1)).alias("conf"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("dea")
    )
    days = cells.agg(F.array_sort(F.collect_set("day")).alias("days"))
    serial = F.transform("days", lambda d: F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
    out = []
    for name in ("conf", "dea"):
        by_day = F.map_from_entries(F.collect_list(F.struct("day", name)))
        rows = cells.where(F.col(name) > 0).groupBy("o_custkey").agg(by_day.alias("m")).withColumn("days", days.scalar())
        texts = F.transform("days", lambda d: F.coalesce(F.try_element_at("m", d).cast("string"), F.lit("")))
        sheet = F.floor(F.col("o_custkey") / 30).alias("sheet")
        body = rows.select(
            sheet, (F.col("o_custkey") % 30 + 4).alias("at"),
            F.concat_ws(";", F.concat(F.lit("LK-"), "o_custkey"), F.array_join(texts, ";")).alias("line"),
        )
        head = F.array(
            *[F.lit(t) for t in ("Bericht", "Stand", "")],
            F.concat_ws(";", F.lit("Landkreis"), F.array_join(serial, ";")),
        )
        top = rows.select(sheet, "days").distinct().select("sheet", F.posexplode(head).alias("at", "line"))
        total = rows.select(sheet).distinct().select("sheet", F.lit(99).alias("at"), F.lit("Summe;1").alias("line"))
        path = scratch_dir(spark, f"sheets-{name}")
        lines = top.unionByName(body).unionByName(total).repartition("sheet").sortWithinPartitions("sheet", "at")
        lines.select("sheet", "line").write.partitionBy("sheet").text(path)
        out.append(files.read_range(spark, path, skip=3, n_max=39))
    return out


@query
def scan_range_serial_dates(spark, sf):
    return pipelines.district_long(*_sheets(spark, sf))


def _customer_pages(spark, sf):
    """Web pages with a table of fifty customers each, under a two-row header."""
    cells = [F.concat("c_name", F.lit(" &amp; Co")), F.col("c_nationkey"), F.col("c_acctbal")]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    head = (
        "<tr><th></th><th>letzte</th><th>F&auml;lle</th></tr>"
        "<tr><th>Kreis/Stadt</th><th>7 <b>Tage</b></th><th>gesamt</th></tr>"
    )
    rows = P.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 50).alias("page_id"), "c_custkey", row.alias("tr"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "tr"))), lambda r: r["tr"])
    return rows.groupBy("page_id").agg(
        F.concat(F.lit(f"<html><body><h1>x</h1><table>{head}"), F.array_join(ordered, ""), F.lit("</table></body></html>")).alias("html")
    )


@query
def html_tables_promote(spark, sf):
    rows = html.read_html_tables(_customer_pages(spark, sf))
    names = [" Kreis/Stadt", "letzte 7 Tage", "Fälle gesamt"]
    table = reshape.promote_header(rows, ["page_id", "table_idx"], names, header_rows=2)
    return table.select(
        "page_id", q(names[0]).alias("district"), num(q(names[1])).alias("last7"), num(q(names[2])).alias("total")
    )


@query
def html_tables_drop_rows(spark, sf):
    rows = html.read_html_tables(_customer_pages(spark, sf))
    table = reshape.promote_header(rows, ["page_id", "table_idx"], ["", "letzte"], header_rows=1, drop_rows=(1, 25))
    return table.select("page_id", "row_idx", q("").alias("district"), num("letzte").alias("last7"))


@query
def html_tables_rowspan(spark, sf):
    """Pages with one nation cell over all customers of the nation on the page."""
    rows = P.table(spark, sf, "customer").groupBy(F.floor(F.col("c_custkey") / 50).alias("page_id"), "c_nationkey").agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("c")
    )
    cell = lambda c: F.concat(F.lit("<td>"), c["c_name"], F.lit("</td>"))
    first = F.concat(F.lit("<tr><td rowspan="), F.size("c").cast("string"), F.lit(">"), F.col("c_nationkey").cast("string"), F.lit("</td>"))
    others = F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), lambda c: F.concat(F.lit("<tr>"), cell(c), F.lit("</tr>")))
    block = F.concat(first, cell(F.col("c")[0]), F.lit("</tr>"), F.array_join(F.when(F.size("c") > 1, others).otherwise(F.array()), ""))
    blocks = rows.select("page_id", F.struct("c_nationkey", block.alias("tr")).alias("b")).groupBy("page_id").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    body = F.array_join(F.transform("bs", lambda b: b["tr"]), "")
    head = F.lit("<table><tr><th>Land<th>Name</tr>")
    pages = blocks.select("page_id", F.concat(head, body, F.lit("</table>")).alias("html"))
    table = reshape.promote_header(html.read_html_tables(pages), ["page_id", "table_idx"], ["Land", "Name"])
    return table.select("page_id", F.col("Land").try_cast("int").alias("nation"), F.col("Name").alias("name"))


@query
def html_tables_pages(spark, sf):
    pages = P.table(spark, sf, "pages")
    found = html.read_html_tables(pages).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    return pages.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("table_rows")
    )


def _responses(spark, sf):
    """Page-view responses: one document per language and title, its items one per day."""
    lang = F.when(F.col("user_id") % 2 == 0, "de").otherwise("en").alias("lang")
    daily = P.table(spark, sf, "events").groupBy(lang, F.col("event_type").alias("title"), F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("views")
    )
    item = F.struct(
        F.col("title").alias("article"), F.date_format("d", "yyyyMMdd00").alias("timestamp"), "views", F.lit("daily").alias("granularity")
    )
    return daily.groupBy("lang", "title").agg(
        F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("body")
    )


@query
def json_items(spark, sf):
    return json_items_module.read_items(_responses(spark, sf)).select("lang", "article", "day", "views")





@query
def json_items_by_title(spark, sf):
    titles = json_items_module.titles_frame(spark, ["click", "view", "click", "none"])
    return json_items_module.items_by_title(_responses(spark, sf), titles).drop("title")


@query
def write_read_snapshot(spark, sf):
    folder = scratch_dir(spark, "panel")
    long = P.country_long(spark, sf).drop("Lat", "Long")
    long = long.withColumn("share", try_div("dea", "conf") * F.lit(1e-9))
    sinks.write_snapshot(long, folder, P.AS_OF, "csv2")
    return files.read_csv2(spark, folder, long.schema).drop("snapshot")


@query
def write_read_csv(spark, sf):
    folder = scratch_dir(spark, "panel")
    long = P.country_long(spark, sf).drop("Lat", "Long").withColumn("share", try_div("dea", "conf") * F.lit(1e-9))
    sinks.write_snapshot(long, folder, P.AS_OF, "csv")
    return spark.read.schema(long.schema).option("header", True).csv(folder).drop("snapshot")


@query
def write_read_partition(spark, sf):
    folder = scratch_dir(spark, "panel")
    long = P.country_long(spark, sf).drop("Lat", "Long")
    sinks.write_snapshot(long, folder, P.AS_OF)
    sinks.write_snapshot(long, folder, P.AS_OF)
    sinks.write_snapshot(long, folder, P.AS_OF - dt.timedelta(days=1), "parquet")
    return spark.read.parquet(folder).where(F.col("snapshot") == F.lit(P.AS_OF))


@query
def publish_atomic(spark, sf):
    """Two days published by version: one is rerun, and a writer of the other ends before its mark."""
    folder = scratch_dir(spark, "published")
    long = P.country_long(spark, sf).drop("Lat", "Long")
    sinks.publish_snapshot(long.where("conf > 10"), folder, P.AS_OF)
    sinks.publish_snapshot(long, folder, P.AS_OF)
    sinks.publish_snapshot(long.where("dea = 0"), folder, P.AS_OF - dt.timedelta(days=1), "csv2")
    long.where("conf > 5").write.parquet(f"{folder}/snapshot={P.AS_OF}/version=unmarked")
    return sinks.read_published(spark, folder, long.schema, P.AS_OF)


@query
def scan_first_lines(spark, sf):
    """The first ten rows of compressed files, one per status."""
    folder = scratch_dir(spark, "orders")
    orders = P.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_custkey")
    line = F.concat_ws(";", "o_orderkey", "o_custkey")
    head = orders.select(F.col("o_orderstatus").alias("status"), F.lit(0).cast("bigint").alias("at"), F.lit("order;customer").alias("line")).distinct()
    body = orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"), line.alias("line"))
    lines = head.unionByName(body).repartition("status").sortWithinPartitions("status", "at")
    lines.select("status", "line").write.partitionBy("status").option("compression", "gzip").text(folder)
    rows = files.read_range(spark, folder, skip=0, n_max=10).where("row_idx > 0")
    return rows.select(
        F.regexp_extract("file", "status=([A-Z]+)", 1).alias("status"), "row_idx",
        F.col("cells")[0].cast("bigint").alias("o_orderkey"), F.col("cells")[1].cast("bigint").alias("o_custkey"),
    )


@query
def stream_snapshots_keyed(spark, sf):
    """As ``stream_snapshots``, with the rows seen as keyed state."""
    folder, base = _snapshot_folder(spark, sf), scratch_dir(spark, "ingest")
    stream = ingest.stream_folder(spark, folder, _snapshot_schema(spark), files_per_batch=12)
    ingest.ingest_keyed(stream, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return _plain(ingest.read_ingested(spark, f"{base}/table", _snapshot_schema(spark)).withColumn(P.DISTRICT, strip_chars(q(P.DISTRICT), "- ")))


@query
def stream_snapshots(spark, sf):
    folder, base = _snapshot_folder(spark, sf), scratch_dir(spark, "ingest")
    stream = ingest.stream_folder(spark, folder, _snapshot_schema(spark), files_per_batch=12)
    run = ingest.ingest_snapshots(stream, f"{base}/table", f"{base}/checkpoint")
    run.awaitTermination()
    return _plain(ingest.read_ingested(spark, f"{base}/table", _snapshot_schema(spark)).withColumn(P.DISTRICT, strip_chars(q(P.DISTRICT), "- ")))


# Projection and reshape


@query
def project_select(spark, sf):
    panel = reshape.select_range(_en(spark, sf), 2, "conf", "rec")
    return reshape.rename_positions(panel, {3: "confirmed", 4: "deaths"}).withColumn("status", F.lit("Beobachtung"))


@query
def columns_by_range(spark, sf):
    return reshape.select_range(_en(spark, sf).drop("weekday", "cfr_1"), 2, "cfr_2", "conf_1")


@query
def map_columns(spark, sf):
    text = _en(spark, sf).select("region", "date", *[F.col(c).cast("string").alias(c) for c in ("conf", "dea", "rec")])
    return reshape.map_columns(text, num, exclude=("region", "date"))


@query
def unpivot_subset(spark, sf):
    return reshape.unpivot_some(_en(spark, sf), ["conf", "dea", "rec", "active"], "measure", "value", ["region", "date"])


@query
def pivot_estimators(spark, sf):
    long = metrics.estimators_long(_en(spark, sf))
    return reshape.pivot_declared(long, ["region", "date"], "estimator", "value", ["cfr_1", "cfr_2", "cfr_adv"], unique=True)


@query
def label_map(spark, sf):
    long = reshape.unpivot_some(_en(spark, sf), ["conf", "dea", "rec", "active"], "measure", "value", ["region", "date"])
    return reshape.with_label(long, "measure", metrics.TOTAL_LABELS)


# Joins


@query
def null_safe_left_join(spark, sf):
    return _plain(pipelines.join_measures(*P.country_tables(spark, sf)))


@query
def natural_left_join(spark, sf):
    conf, _, rec = P.country_tables(spark, sf)
    moved = rec.withColumn("Lat", F.when(F.col("Lat") % 10 == 3, F.col("Lat") + 0.5).otherwise(F.col("Lat")))
    return _plain(joins.join_natural(conf, moved))


@query
def inner_one_key(spark, sf):
    panel, listed = _listed(spark, sf)
    last = select.top_n_per(joins.keep_listed(panel, listed, "region"), "region", 1, "date")
    return panel.join(metrics.mean_fatality(last), "region").select("region", "date", "conf", "cfr_mean")


@query
def inner_suffix_join(spark, sf):
    fan = projection.exponential_fan(_staged(spark, sf)).select("region", "date", "status", "scenario", "need")
    one, two, three = [fan.where(F.col("scenario") == i).drop("scenario") for i in (1, 2, 3)]
    pair = joins.join_suffixed(one, two, ["region", "date", "status"], ("_rate_1", "_rate_2"))
    return joins.join_suffixed(pair, three, ["region", "date", "status"], ("", ""))


@query
def semi_join_list(spark, sf):
    panel, listed = _listed(spark, sf)
    return joins.keep_listed(panel, listed, "region").select("region", "date", "conf")


@query
def scalar_cross(spark, sf):
    panel = _staged(spark, sf).select("region", "date", "conf")
    newest = panel.agg(F.max("date"))
    return joins.with_scalar(panel, newest, "newest").withColumn("age_days", F.datediff("newest", "date"))


# Aggregation


@query
def sum_strict_country(spark, sf):
    return metrics.aggregate_panel(P.country_long(spark, sf))


@query
def max_date(spark, sf):
    return P.country_long(spark, sf).agg(F.max("date").alias("updated"))


@query
def ratio_of_sums_band(spark, sf):
    items = P.table(spark, sf, "lineitem").select("l_quantity", "l_linestatus")
    deaths = F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
    return items.withColumn("band", cut_right("l_quantity", (1, 10, 25, 40))).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), try_div(sum_or_zero(deaths), sum_or_zero("l_quantity")).alias("ratio")
    )


@query
def distinct_rows(spark, sf):
    return P.country_long(spark, sf).select("region", "province").distinct()


@query
def last_per_group(spark, sf):
    return select.last_per_group(P.country_long(spark, sf).groupBy("region", "date").agg(F.sum("conf").alias("conf")), "region", "date")


@query
def linreg_by_group(spark, sf):
    rows = P.district_counts(spark, sf).withColumn("step", windows.row_index(windows.series()))
    return _round(stats.linear_fit_summary(rows, "region", "conf", "step"), "intercept", "slope")


def _trend_columns(df, key="region", date="date", y="last_7"):
    return _round(df.select(q(key).alias("region"), q(date).alias("stamp"), "step", q(y).alias("y"), "intercept", "slope", "trend"), "intercept", "slope")


@query
def trend_class(spark, sf):
    return _trend_columns(reports.district_trend(_en(spark, sf)))


@query
def trend_class_district(spark, sf):
    return _trend_columns(reports.district_trend(P.district_enriched(spark, sf)))


@query
def trend_class_snapshots(spark, sf):
    rows = P.district_snapshots(spark, sf)
    return _trend_columns(reports.snapshot_trend(rows, P.DISTRICT, P.LAST_7), P.DISTRICT, "update", P.LAST_7)


@query
def weekday_box(spark, sf):
    panel, listed = _listed(spark, sf)
    box = reports.weekday_box(panel, listed, P.OUTLIERS)
    text = F.transform("outliers", lambda x: x.cast("bigint").cast("string"))
    return box.withColumn("outliers", F.array_join(text, ";"))


@query
def category_order(spark, sf):
    rows = _snapshots(spark, sf)
    return _plain(stats.order_by_aggregate(rows, P.DISTRICT, P.LAST_7, "median"))


@query
def category_order_max(spark, sf):
    rows = _snapshots(spark, sf)
    return _plain(stats.order_by_aggregate(rows, P.DISTRICT, P.INCIDENCE, "max"))


# Windows


def _series(spark, sf, **cols):
    w = windows.series()
    panel = metrics.aggregate_panel(P.country_long(spark, sf))
    return panel.select("region", "date", *[fn(w).alias(name) for name, fn in cols.items()])


@query
def diff_default0(spark, sf):
    return _series(spark, sf, conf_1=lambda w: windows.change("conf", w), dea_1=lambda w: windows.change("dea", w), rec_1=lambda w: windows.change("rec", w))


@query
def diff_null(spark, sf):
    return _series(spark, sf, conf_1=lambda w: windows.change_or_null("conf", w))


@query
def lag_delays(spark, sf):
    return _series(
        spark, sf,
        conf_7=lambda w: windows.shifted_change("conf", 7, w),
        conf_10=lambda w: windows.shifted_change("conf", 10, w),
        dea_13=lambda w: windows.shifted_change("dea", 13, w),
        rec_13=lambda w: windows.shifted_change("rec", 13, w),
        conf_total_20=lambda w: windows.shift("conf", 20, w),
    )


@query
def diff7(spark, sf):
    w = windows.series()
    return P.district_counts(spark, sf).select("region", "date", windows.change("conf", w, 7).alias("last_7"))


@query
def running_sum_strict(spark, sf):
    w = windows.series()
    rows = metrics.aggregate_panel(P.country_long(spark, sf)).withColumn(
        "x", F.when((F.col("conf") % 7 == 0) & (F.dayofmonth("date") > 20), None).otherwise(windows.change("conf", w))
    )
    return rows.select("region", "date", "x", cumsum_strict("x", w).alias("total"))


@query
def adjusted_cfr(spark, sf):
    return _en(spark, sf).select("region", "date", "cfr_adv")


@query
def lead_growth(spark, sf):
    return _series(spark, sf, g=lambda w: windows.lead_growth("conf", w))


@query
def rate_per_active(spark, sf):
    return _en(spark, sf).select("region", "date", windows.rate_per_previous("conf_1", "active", windows.series()).alias("g"))


@query
def doubling_time_rows(spark, sf):
    return _round(_en(spark, sf).select("region", "date", "doubling"), "doubling")


@query
def quality_flag(spark, sf):
    return _en(spark, sf).select("region", "date", "est_quality")


@query
def loess_growth(spark, sf):
    return _round(reports.growth_smoothed(_staged(spark, sf)), "fit")


@query
def loess_rate(spark, sf):
    return _round(reports.rate_smoothed(_staged(spark, sf)), "fit")


@query
def loess_curve(spark, sf):
    rates = _staged(spark, sf).select("region", "date", windows.lead_growth("conf", windows.series()).alias("g"))
    return _round(loess.loess_grid(filters.within(rates, "g", 0, 1), "region", "date", "g", 0.5), "x", "fit")


# Long series: a few series hold all rows of the largest table, so windows and quantiles work by blocks


def _line_series(spark, sf):
    """Line items in the order they shipped, one series per return flag."""
    return P.table(spark, sf, "lineitem").select("l_returnflag", *LINE_ORDER, F.col("l_quantity").alias("x"))


def _line_blocks(rows):
    return Blocks.of(rows, "l_returnflag", [*LINE_ORDER, "x"], LINE_BLOCK)


LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
#: So small that the series of the test tables have several blocks.
LINE_BLOCK = 1 << 12


@query
def series_blocks(spark, sf):
    def offsets(w):
        return {
            "change": windows.change("x", w), "change_null": windows.change_or_null("x", w), "shift_20": windows.shift("x", 20, w),
            "change_7": windows.change("x", w, 7), "delayed": windows.shifted_change("x", 13, w), "growth": windows.lead_growth("x", w),
        }

    return _plain(_line_blocks(_line_series(spark, sf)).with_offsets(offsets, back=20, ahead=1).frame())


@query
def running_blocks(spark, sf):
    rows = _line_series(spark, sf).withColumn("y", F.when(~((F.col("l_linenumber") == 7) & (F.year("l_shipdate") > 1995)), F.col("x")))
    sums = _line_blocks(rows).with_running({"total": "x", "strict": "y"}).with_running({"loose": "y"}, strict=False)
    return _plain(sums.frame())


@query
def adjusted_cfr_blocks(spark, sf):
    """All metrics by blocks of 14 days, the reach of the delays."""
    panel = metrics.aggregate_panel(P.country_long(spark, sf))
    return metrics.add_metrics_blocked(panel, size=14).select("region", "date", "cfr_adv")


@query
def quantiles_spread(spark, sf):
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75, "q99": 0.99}
    return _round(stats.quantiles(P.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", shares), *shares)


@query
def box_outliers_spread(spark, sf):
    rows = P.table(spark, sf, "events").where("value IS NOT NULL")
    return stats.box_outliers(rows, ["event_type"], "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("most"))


@query
def loess_rate_spread(spark, sf):
    """The smoother of ``loess_rate`` as it works on series of any length."""
    rates = _staged(spark, sf).select("region", "date", windows.rate_per_previous("conf_1", "active", windows.series()).alias("g"))
    return _round(loess.loess_fit(rates.where("g IS NOT NULL"), "region", "date", "g", 0.2, spread=True), "fit")


# Panels with missing days


def _active_days(spark, sf):
    """Events of users by day: only days with events have a row."""
    events = P.table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("date"))
    return events.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("value").alias("value"), F.max("event_id").cast("double").alias("last_id"))


@query
def gap_fill_days(spark, sf):
    """Filled days, then offsets in rows, which are days now."""
    rows = stage(_active_days(spark, sf), "active-days")
    ends = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    rules = {"n": "zero", "last_id": "carry", "value": "linear"}
    full = gaps.fill_days(rows, rules, "user_id", "date", last=ends.select("hi").scalar(), filled="filled")
    w = windows.series("user_id", "date")
    return _round(full.withColumn("week", windows.change("last_id", w, 7)), "value")


@query
def day_offsets(spark, sf):
    rows, w = _active_days(spark, sf), gaps.days("user_id", "date")
    return rows.select(
        "user_id", "date", "n", gaps.shift_days("n", 7, w).alias("n_7"), gaps.change_days("last_id", 3, w).alias("id_3"), gaps.last_known("n", 7, w).alias("known_7")
    )


# Order and selection


def _user_totals(spark, sf):
    return P.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query
def topk_ties(spark, sf):
    return select.top_k_ties(_user_totals(spark, sf), 10, "n")


@query
def bottomk_ties(spark, sf):
    return select.bottom_k_ties(_user_totals(spark, sf), 10, "n")


@query
def topn_per_region(spark, sf):
    return select.top_n_per(_en(spark, sf), "region", 3, "conf_1").select("region", "date", "conf_1")


@query
def last_rows_per_region(spark, sf):
    return select.last_rows(_en(spark, sf), "region", 10, "date").select("region", "date", "conf")


@query
def pick_from_end(spark, sf):
    return select.nth_last(_en(spark, sf), "region", projection.DELAY_ROWS, "date").select("region", "date", "active", "conf_1")


@query
def ordinal_before_filter(spark, sf):
    return select.global_row_number(_user_totals(spark, sf), "n", "user_id", descending=True)


@query
def sort_preview(spark, sf):
    return select.preview(_en(spark, sf).orderBy(F.desc("conf"), "region", "date"), 6).select("region", "date", "conf")


@query
def pick_region_list(spark, sf):
    return _listed(spark, sf)[1]


# Set operations


@query
def union_fill(spark, sf):
    panel = _staged(spark, sf).select("region", "date", "conf", "active")
    later = panel.groupBy("region").agg(F.max("date").alias("date"), F.max("conf").alias("conf"))
    return reshape.union_fill(panel, later.withColumn("status", F.lit("Prognose")))


@query
def union_tagged(spark, sf):
    panel = _staged(spark, sf)
    return reshape.union_tagged({"tested": panel.select("region", "date", F.col("conf").alias("x")), "death": panel.select("region", "date", F.col("dea").alias("x"))})


# Filters


@query
def filters_bundle(spark, sf):
    panel = _en(spark, sf)
    keep = (F.col("region").isin("C1", "C2", "C3") & (F.col("est_quality") == "mittel")) | (
        F.col("region").isin("C4", "C7") & (F.col("conf_1") > 0) & (F.col("weekday") != "Sonntag")
    )
    return panel.where(keep).select("region", "date", "conf_1", "weekday")


@query
def not_in_keeps_null(spark, sf):
    return P.country_long(spark, sf).where(not_in_set("province", ["P25", "P26", "P30"])).select("region", "province", "date", "conf")


@query
def exclude_cell(spark, sf):
    return filters.exclude_cells(_en(spark, sf), P.OUTLIERS).select("region", "date", "conf_1")


@query
def exclude_cell_list(spark, sf):
    panel = _staged(spark, sf).select("region", "date", "conf_1")
    worst = select.top_n_per(panel, "region", 1, "conf_1").select("region", "date")
    return joins.drop_listed(panel, worst, ["region", "date"])


@query
def same_weekday(spark, sf):
    return filters.same_weekday(_en(spark, sf), P.AS_OF).select("region", "date", "conf")


@query
def two_snapshots(spark, sf):
    return _plain(filters.two_snapshots(P.district_snapshots(spark, sf), dt.date(2024, 1, 30)))


@query
def regex_filter(spark, sf):
    rows = filters.matching(P.district_snapshots(spark, sf), q(P.DISTRICT), "esamt", keep=False)
    return _plain(filters.matching(rows, q(P.DISTRICT), "1"))


@query
def axis_domain(spark, sf):
    rows = filters.positive(filters.within(_en(spark, sf), "cfr_1", 0, 0.2), "doubling")
    return rows.select("region", "date", "cfr_1")


# Scalar functions


@query
def scalars_text(spark, sf):
    part = P.table(spark, sf, "part")
    return part.select(
        "p_partkey",
        replace_first("p_name", " ", "$").alias("first_blank"),
        strip_chars(F.concat("p_name", F.lit("-"), "p_brand"), "- ").alias("stripped"),
        paste("p_brand", F.when(F.col("p_size") > 10, F.col("p_size")), "p_type").alias("pasted"),
        F.substring("p_type", 1, 3).alias("head"),
        num("p_brand").alias("no_number"),
        num(F.substring("p_brand", 7, 9)).alias("brand_no"),
        num_comma(F.concat(F.lit("1."), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(",5"))).alias("comma"),
    )


@query
def scalars_num(spark, sf):
    orders = P.table(spark, sf, "orders")
    price = F.col("o_totalprice")
    share = try_div(F.col("o_custkey"), F.col("o_orderkey"))
    return orders.select(
        "o_orderkey",
        F.round(share, 3).alias("share_3"),
        round_even(F.col("o_custkey") * 0.5).alias("half_even"),
        clamp_below(F.when(F.col("o_orderstatus") != "P", price - 200000), 0).alias("clamped"),
        fill_zero(F.when(F.col("o_orderstatus") == "F", price)).alias("filled"),
        F.round(doubling_time(try_div(F.col("o_custkey"), F.lit(300))), 6).alias("doubling"),
        F.round(F.pow(F.lit(1.05), F.col("o_custkey") % 10), 9).alias("power"),
        flag_above(F.when(F.col("o_orderstatus") != "P", price), 250000, "mittel", "gering").alias("flag"),
        cut_right("o_totalprice", (1000, 100000, 250000, 400000), ("low", "middle", "high")).alias("band"),
    )


@query
def scalars_date(spark, sf):
    orders = P.table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date"))
    return orders.select(
        "o_orderkey",
        date_mdy(F.concat_ws("/", F.month(day), F.dayofmonth(day), F.date_format(day, "yy"))).alias("mdy"),
        date_mdy(F.concat(F.lit("x"), "o_orderkey")).alias("mdy_bad"),
        date_ymd(F.date_format(day, "yyyy-MM-dd")).alias("ymd"),
        date_yyyymmdd(F.date_format(day, "yyyyMMdd00")).alias("stamp_day"),
        timestamp_ymd_hms(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 09:30:00"))).alias("ymd_hms"),
        serial_date(serial.cast("string")).alias("serial"),
        weekday_label(day).alias("weekday"),
        weekday_label(day, "level_order").alias("weekday_level"),
        add_days(day, 7).alias("week_later"),
        add_days(day, -7).alias("week_before"),
    )


@query
def thousands_repair(spark, sf):
    part = P.table(spark, sf, "part")
    damaged = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).otherwise(try_div(F.col("p_size") + 1000, F.lit(1000)))
    return part.select("p_partkey", damaged.alias("damaged"), repair_thousands(damaged).alias("repaired"))


@query
def density_norm(spark, sf):
    part = P.table(spark, sf, "part")
    thousands = implied_thousands("p_size", F.col("p_retailprice") - 900)
    return part.select("p_partkey", thousands.alias("thousands"), daily_per_100(F.col("p_size"), thousands).alias("per_100"))


# Composites and reports


@query
def enrich_country(spark, sf):
    return _round(_en(spark, sf), "doubling")


@query
def enrich_district(spark, sf):
    return _round(P.district_enriched(spark, sf), "doubling")


@query
def report_current(spark, sf):
    """From three wide frames, one column per day, to the current table of the top ten and the manual list."""
    panel = stage(pipelines.country_panel(*P.country_wide(spark, sf)), "panel")
    return reports.current_table(panel, select.pick_regions(panel, 10, manual=P.MANUAL))


@query
def report_published(spark, sf):
    panel, listed = _listed(spark, sf)
    table = reports.with_headings(reports.current_table(panel, listed))
    return sinks.publish_table(table, "aktu_data", scratch_dir(spark, "aktu_data"))


@query
def report_totals(spark, sf):
    return reports.totals(*_listed(spark, sf))


@query
def report_daily(spark, sf):
    return reports.daily_changes(*_listed(spark, sf), P.OUTLIERS)


@query
def report_active_delta(spark, sf):
    return reports.active_changes(*_listed(spark, sf), P.OUTLIERS)


@query
def report_growth(spark, sf):
    return _round(reports.growth_smoothed(*_listed(spark, sf)), "fit")


@query
def report_rate(spark, sf):
    return _round(reports.rate_smoothed(*_listed(spark, sf)), "fit")


@query
def report_estimators(spark, sf):
    return reports.estimators(*_listed(spark, sf))


@query
def report_trajectory(spark, sf):
    return reports.trajectory(*_listed(spark, sf), P.AS_OF)


@query
def report_trajectory_15(spark, sf):
    return reports.trajectory_drawn(reports.trajectory(*_listed(spark, sf), P.AS_OF, 15))


@query
def report_trajectory_last(spark, sf):
    return reports.trajectory_last(reports.trajectory(*_listed(spark, sf), P.AS_OF))


@query
def report_incidence_rank(spark, sf):
    """Web-table text per nation: total and newest orders, rate per 100,000 customers."""
    last = select.top_n_per(_districts(spark, sf), "region", 1, "date")
    people = P.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    named = people.join(P.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("region"), "people")
    rate = F.round(try_div("conf", "people") * 100000, 1)
    rows = last.join(named, "region").select(
        "region", *[c.cast("string").alias(n) for c, n in ((F.col("conf"), "count"), (F.col("conf_1"), "new"), (rate, "rate"))]
    )
    return _round(reports.incidence_ranking(rows, "region", "count", "new", "rate"), "inhabitants_thousands", "new_per_100")


@query
def report_two_snapshot(spark, sf):
    return reports.snapshot_change(_snapshots(spark, sf), P.DISTRICT, P.INCIDENCE, dt.date(2024, 1, 30))


@query
def report_timeline(spark, sf):
    return reports.timeline(P.district_snapshots(spark, sf), P.DISTRICT, P.INCIDENCE)


@query
def report_timeline_named(spark, sf):
    return reports.timeline(P.district_snapshots(spark, sf), P.DISTRICT, P.CUMULATED, None, "- 1")


@query
def report_district_top(spark, sf):
    return reports.district_extremes(_districts(spark, sf))


@query
def report_district_bottom(spark, sf):
    return reports.district_extremes(_districts(spark, sf), largest=False)


@query
def report_district_daily(spark, sf):
    return reports.daily_changes(P.district_enriched(spark, sf))


@query
def report_district_table(spark, sf):
    return reports.district_table(_districts(spark, sf))


@query
def recovery_estimate(spark, sf):
    return _round(reports.recovery(*_listed(spark, sf)), "value")


@query
def scenario_exponential(spark, sf):
    return _round(reports.scenario_totals(_staged(spark, sf)), "value", digits=3)


@query
def scenario_recurrent(spark, sf):
    return _round(reports.scenario_active(_staged(spark, sf)), "value", digits=3)


def _age_tables(spark, sf):
    """Wide tables of counts by line number and return flag; thousands points are read as decimal points."""
    items = P.table(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", "l_linestatus")
    sex = {"weiblich": "A", "männlich": "N", "unbekannt": "R"}

    def wide(rows):
        n = {s: F.count(F.when(F.col("l_returnflag") == flag, 1)) for s, flag in sex.items()}
        cells = rows.groupBy(F.col("l_linenumber").alias("line")).agg(*[c.alias(s) for s, c in n.items()])
        total = cells.agg(*[F.sum(s).alias(s) for s in sex]).withColumn("line", F.lit(None).cast("int"))
        band = F.when(F.col("line").isNull(), "Gesamt").when(F.col("line") == 7, "Unbekannt").otherwise(F.concat(F.lit("Alter "), "line"))
        damaged = [F.when(F.col(s) >= 1000, F.col(s) / 1000.0).otherwise(F.col(s).cast("double")).alias(s) for s in sex]
        return cells.unionByName(total).select(band.alias("Altersgruppe (Jahre)"), *damaged)

    return wide(items), wide(items.where(F.col("l_linestatus") == "F"))


@query
def ratio_two_dims(spark, sf):
    tested, death = _age_tables(spark, sf)
    return reports.age_sex_ratio(tested, death, "Altersgruppe (Jahre)", ["weiblich", "männlich", "unbekannt"], "unbekannt", "Unbekannt")


@query
def ratio_by_band(spark, sf):
    """Parts as districts: line counts, returns (a dash for none), and a rate text with a decimal comma."""
    counts = P.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r")
    )
    part = P.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    rows = part.join(counts, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("n").cast("double").alias("cases"),
        F.when(F.col("r") == 0, "-").otherwise(F.col("r").cast("string")).alias("deaths"),
        F.regexp_replace(F.round((F.col("p_retailprice") - 900) * 16, 1).cast("decimal(12,1)").cast("string"), r"\.", ",").alias("incidence"),
    )
    return reports.band_ratio(rows, "cases", "deaths", "incidence")


@query
def pageviews(spark, sf):
    titles = json_items_module.titles_frame(spark, ["click", "purchase"], "en")
    return reports.page_views(_responses(spark, sf), titles)


@query
def freshness(spark, sf):
    return reports.freshness(P.district_snapshots(spark, sf), "update")


@query
def report_dashboard_snapshot(spark, sf):
    """A prepared district file: decimal commas, stamps as text, a total row of another name."""
    path = scratch_dir(spark, "dashboard")
    rows = _plain(P.district_snapshots(spark, sf)).withColumns(
        {
            "district": F.when(F.col("district") == P.TOTAL, "gesamt").otherwise(F.col("district")),
            "update": F.date_format("update", "yyyy-MM-dd HH:mm:ss"),
        }
    )
    sinks.decimal_comma(rows).write.option("header", True).option("sep", ";").csv(path)
    return reports.dashboard_snapshot(files.read_csv2(spark, path, rows.schema), "district", "update")
