"""SQL twins of the queries, written independently of the DataFrame code.

Shared subqueries are named once and put in front of a query by ``sql``.
"""

from __future__ import annotations

MANUAL = "('C1', 'C2')"
EVENT_DAY = "CAST(ts AS DATE)"

CTE: dict[str, str] = {}
ORACLE: dict[str, str] = {}

# Users by day, dense; provinces; countries
CTE["ev_daily"] = f"""SELECT user_id AS u, {EVENT_DAY} AS d, count(*) AS c,
    count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'purchase') AS p
  FROM events GROUP BY 1, 2"""
CTE["ev_days"] = f"""SELECT CAST(unnest(generate_series(min({EVENT_DAY}), max({EVENT_DAY}), INTERVAL 1 DAY)) AS DATE) AS d
  FROM events"""
CTE["ev_user"] = """SELECT g.u, g.d AS date,
    CAST(sum(coalesce(t.c, 0)) OVER w AS DOUBLE) AS conf, CAST(sum(coalesce(t.e, 0)) OVER w AS DOUBLE) AS dea,
    CAST(sum(coalesce(t.p, 0)) OVER w AS DOUBLE) AS rec
  FROM (SELECT DISTINCT k.u, x.d FROM ev_daily k, ev_days x) g LEFT JOIN ev_daily t ON t.u = g.u AND t.d = g.d
  WINDOW w AS (PARTITION BY g.u ORDER BY g.d)"""
CTE["ev"] = """SELECT CASE WHEN u >= 25 THEN 'P' || u END AS province, 'C' || (u % 25) AS region,
    CAST(u % 90 AS DOUBLE) AS lat, CAST(u % 180 AS DOUBLE) AS lon, date, conf, dea,
    CASE WHEN u % 50 <> 7 THEN rec END AS rec, u
  FROM ev_user"""
CTE["cp"] = """SELECT region, date, sum(conf) AS conf, sum(dea) AS dea,
    CASE WHEN count(rec) = count(*) THEN sum(rec) END AS rec
  FROM ev GROUP BY 1, 2"""

WEEKDAY = """['Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag'][isodow({0})]"""


def _enriched(panel: str, prefix: str, rec: bool) -> None:
    by = "(PARTITION BY region ORDER BY date)"
    more = ", dea / nullif(dea + rec, 0) AS cfr_2, conf - dea - rec AS active, rec - lag(rec, 1, 0) OVER w AS rec_1" if rec else ""
    CTE[f"{prefix}1"] = f"""SELECT *, dea / nullif(conf, 0) AS cfr_1, {WEEKDAY.format('date')} AS weekday,
        conf - lag(conf, 1, 0) OVER w AS conf_1, dea - lag(dea, 1, 0) OVER w AS dea_1,
        conf - lag(conf, 7, 0) OVER w AS last_7, conf / nullif(lag(conf, 3) OVER w, 0) AS r3{more}
      FROM {panel} WINDOW w AS {by}"""
    act = ", active - lag(active, 1, 0) OVER w AS active_1" if rec else ""
    CTE[f"{prefix}2"] = f"""SELECT *, lag(dea_1, 13, 0) OVER w AS dea_1_shift, lag(conf_1, 7, 0) OVER w AS conf_1_shift,
        lag(conf_1, 10, 0) OVER w AS conf_1_shift_alt,
        round(CASE WHEN r3 > 0 THEN ln(8) / nullif(ln(r3), 0) END, 6) + 0.0 AS doubling{act}
      FROM {prefix}1 WINDOW w AS {by}"""
    CTE[f"{prefix}"] = f"""SELECT * EXCLUDE (r3), sum(dea_1) OVER w / nullif(sum(conf_1_shift) OVER w, 0) AS cfr_adv,
        CASE WHEN sum(dea_1) OVER w > 20 THEN 'mittel' ELSE 'gering' END AS est_quality
      FROM {prefix}2 WINDOW w AS {by}"""


_enriched("cp", "en", True)

# Nations by month
CTE["om"] = """SELECT n_name AS region, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS c,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS f
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"""
CTE["orp"] = """SELECT region, date, CAST(sum(c) OVER w AS DOUBLE) AS conf, CAST(sum(f) OVER w AS DOUBLE) AS dea
  FROM om WINDOW w AS (PARTITION BY region ORDER BY date)"""
_enriched("orp", "oe", False)

# District snapshots with a total row
CTE["heu"] = """SELECT u, date, conf, conf - lag(conf, 7, 0) OVER (PARTITION BY u ORDER BY date) AS last7 FROM ev_user"""
CTE["he"] = """SELECT district, cumulated, last7, last7 * 2.5 AS incidence, CAST(date + INTERVAL 9 HOUR AS TIMESTAMP) AS "update" FROM (
    SELECT 'Kreis - ' || u AS district, date, conf AS cumulated, last7 FROM heu
    UNION ALL SELECT 'Gesamtergebnis', date, sum(conf), sum(last7) FROM heu GROUP BY date)"""

# Region list of the country reports, as a set
CTE["latest"] = """SELECT region, arg_max(conf, date) AS w FROM cp GROUP BY region"""
CTE["picked"] = f"""SELECT region FROM (SELECT region, rank() OVER (ORDER BY w DESC) AS r FROM latest) WHERE r <= 10
  UNION ALL SELECT region FROM latest WHERE region IN {MANUAL}"""
CTE["enl"] = """SELECT * FROM en WHERE region IN (SELECT region FROM picked)"""
CTE["oe_last"] = """SELECT * FROM oe QUALIFY rank() OVER (PARTITION BY region ORDER BY date DESC) = 1"""
CTE["oe_top"] = """SELECT region FROM oe_last QUALIFY rank() OVER (ORDER BY conf DESC) <= 10"""
CTE["oe_bottom"] = """SELECT region FROM oe_last QUALIFY rank() OVER (ORDER BY conf) <= 10"""

# Page-view items
CTE["views"] = f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'de' ELSE 'en' END AS lang, event_type AS article,
    {EVENT_DAY} AS day, count(*) AS views FROM events GROUP BY 1, 2, 3"""

# Scenarios
CTE["rates"] = """SELECT * FROM (VALUES (1, CAST(0.15 AS DOUBLE)), (2, CAST(0.10 AS DOUBLE)), (3, CAST(0.05 AS DOUBLE))) t(scenario, rate)"""
CTE["fan"] = """SELECT region, date, 'Beobachtung' AS status, scenario, rate, conf AS value FROM cp, rates
  UNION ALL
  SELECT region, CAST(last + CAST(i AS INTEGER) AS DATE), 'Prognose', scenario, rate, top * power(1 + rate, CAST(i AS DOUBLE))
  FROM (SELECT region, max(date) AS last, max(conf) AS top FROM cp GROUP BY 1), rates, range(1, 51) s(i)"""



def sql(key: str, body: str, extra: str = "") -> None:
    """Register a query; the shared subqueries it mentions, directly or not, are put in front."""
    import re

    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name, definition in CTE.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(definition)

    visit(body + " " + extra)
    parts = [f"{n} AS (\n  {CTE[n]}\n)" for n in CTE if n in wanted]
    if extra:
        parts.append(extra.strip())
    ORACLE[key] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


# Sources and sinks
sql("scan_wide_unpivot", "SELECT province, region, lat, lon, date, conf FROM ev")
sql("scan_wide_folder", "SELECT province, region, lat, lon, date, conf FROM ev")
sql("scan_csv2", "SELECT * FROM he")
CLEAN = "replace(replace(district, '-', ''), ' ', '')"
sql("scan_folder_distinct", f"SELECT {CLEAN} AS district, cumulated, last7, incidence, \"update\", TIMESTAMP '2024-01-31 09:00:00' AS loaded FROM he")
sql("stream_snapshots", f"SELECT {CLEAN} AS district, cumulated, last7, incidence, \"update\" FROM he")
sql(
    "scan_range_serial_dates",
    """SELECT 'LK-' || k.o_custkey AS district, q.date, CAST(coalesce(c.n, 0) AS DOUBLE) AS conf, CAST(coalesce(c.f, 0) AS DOUBLE) AS dea
    FROM (SELECT DISTINCT o_custkey FROM orders) k CROSS JOIN (SELECT DISTINCT date FROM counted) q
    LEFT JOIN counted c ON c.o_custkey = k.o_custkey AND c.date = q.date""",
    """counted AS (SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, count(*) AS n,
      count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY 1, 2)""",
)
sql(
    "html_tables_promote",
    """SELECT c_custkey // 50 AS page_id, c_name || ' & Co' AS district, CAST(c_nationkey AS DOUBLE) AS last7, c_acctbal AS total
    FROM customer""",
)
sql(
    "html_tables_drop_rows",
    """SELECT c_custkey // 50 AS page_id, CAST(r AS INTEGER) AS row_idx, c_name || ' & Co' AS district, CAST(c_nationkey AS DOUBLE) AS last7
    FROM (SELECT *, 1 + row_number() OVER (PARTITION BY c_custkey // 50 ORDER BY c_custkey) AS r FROM customer) WHERE r <> 25""",
)
sql("html_tables_pages", "SELECT page_id, CAST(len(regexp_extract_all(lower(html), '<tr[ >]')) * CAST(contains(lower(html), '<table') AS INTEGER) AS BIGINT) AS table_rows FROM pages")
sql("json_items", "SELECT lang, article, day, views FROM views")
sql("json_items_by_title", "SELECT lang, article, day, views FROM views WHERE lang = 'de' AND article IN ('click', 'view')")
sql("pageviews", "SELECT article, day, views FROM views WHERE lang = 'en' AND article IN ('click', 'purchase')")
_SHARED = "SELECT region, province, date, conf, dea, rec, CASE WHEN conf <> 0 THEN dea / conf END * 1e-9 AS share FROM ev"
sql("write_read_snapshot", _SHARED)
sql("write_read_csv", _SHARED)
sql("html_tables_rowspan", "SELECT c_custkey // 50 AS page_id, c_nationkey AS nation, c_name AS name FROM customer")
sql(
    "report_dashboard_snapshot",
    f"""SELECT district, cumulated, last7, incidence, "update" AS updated,
      cumulated / nullif((SELECT max(cumulated) FROM he WHERE district = 'Gesamtergebnis' AND "update" = (SELECT max("update") FROM he)), 0) AS share
    FROM he WHERE district <> 'Gesamtergebnis' AND "update" = (SELECT max("update") FROM he)""",
)
sql("write_read_partition", "SELECT region, province, date, conf, dea, rec, DATE '2024-01-31' AS snapshot FROM ev")
sql("publish_atomic", "SELECT region, province, date, conf, dea, rec, DATE '2024-01-31' AS snapshot FROM ev")
sql(
    "scan_first_lines",
    """SELECT o_orderstatus AS status, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS INTEGER) AS row_idx, o_orderkey, o_custkey
    FROM orders QUALIFY row_idx <= 10""",
)
sql("stream_snapshots_keyed", f"SELECT {CLEAN} AS district, cumulated, last7, incidence, \"update\" FROM he")

# Projection and reshape
sql("project_select", "SELECT region, date, conf AS confirmed, dea AS deaths, rec, 'Beobachtung' AS status FROM cp")
sql("columns_by_range", "SELECT region, date, cfr_2, active, dea_1, conf_1 FROM en")
sql("map_columns", "SELECT region, date, conf, dea, rec FROM cp")
_LONG = " UNION ALL ".join(f"SELECT region, date, '{m}' AS measure, {m} AS value FROM en" for m in ("conf", "dea", "rec", "active"))
sql("unpivot_subset", _LONG)
sql("pivot_estimators", "SELECT region, date, cfr_1, cfr_2, cfr_adv FROM en")


def _labelled(source: str, labels: dict[str, str], value: str = "{}") -> str:
    return " UNION ALL ".join(
        f"SELECT region, date, '{m}' AS measure, {value.format(m)} AS value, '{label}' AS label FROM {source}" for m, label in labels.items()
    )


TOTALS = {"conf": "Bestätigt", "dea": "Gestorben", "rec": "Genesen", "active": "Krank"}
CHANGES = {"conf_1": "Bestätigt", "dea_1": "Gestorben", "rec_1": "Genesen"}
sql("label_map", _labelled("en", TOTALS))

# Joins
sql("null_safe_left_join", "SELECT province, region, lat, lon, date, conf, dea, rec FROM ev")
sql("natural_left_join", "SELECT province, region, lat, lon, date, conf, CASE WHEN CAST(lat AS INTEGER) % 10 <> 3 THEN rec END AS rec FROM ev")
CFR = "SELECT region, (round(cfr_1, 3) + round(cfr_adv, 3)) / 2 AS cfr_mean FROM enl QUALIFY row_number() OVER (PARTITION BY region ORDER BY date DESC) = 1"
sql("inner_one_key", "SELECT region, date, conf, cfr_mean FROM en JOIN m USING (region)", f"m AS ({CFR})")
sql(
    "inner_suffix_join",
    """SELECT a.region, a.date, a.status, round_even(a.value * 0.05, 0) AS need_rate_1, round_even(b.value * 0.05, 0) AS need_rate_2,
      round_even(c.value * 0.05, 0) AS need
    FROM fan a JOIN fan b ON a.region = b.region AND a.date = b.date AND a.status = b.status AND a.scenario = 1 AND b.scenario = 2
    JOIN fan c ON a.region = c.region AND a.date = c.date AND a.status = c.status AND c.scenario = 3""",
)
sql("semi_join_list", "SELECT region, date, conf FROM enl")
sql("scalar_cross", "SELECT region, date, conf, (SELECT max(date) FROM cp) AS newest, CAST((SELECT max(date) FROM cp) - date AS INTEGER) AS age_days FROM cp")

# Aggregation
sql("sum_strict_country", "SELECT region, date, conf, dea, rec FROM cp")
sql("max_date", f"SELECT max({EVENT_DAY}) AS updated FROM events")
sql(
    "ratio_of_sums_band",
    """SELECT CASE WHEN l_quantity > 1 AND l_quantity <= 10 THEN '(1,10]' WHEN l_quantity > 10 AND l_quantity <= 25 THEN '(10,25]'
      WHEN l_quantity > 25 AND l_quantity <= 40 THEN '(25,40]' END AS band, count(*) AS n,
      coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) / nullif(sum(l_quantity), 0) AS ratio
    FROM lineitem GROUP BY 1""",
)
sql("distinct_rows", "SELECT DISTINCT region, province FROM ev")
sql("last_per_group", "SELECT region, max(date) AS date, arg_max(conf, date) AS conf FROM cp GROUP BY region")
sql(
    "linreg_by_group",
    """SELECT region, round(CASE WHEN count(*) >= 2 THEN regr_intercept(conf, step) END, 6) + 0.0 AS intercept,
      round(CASE WHEN count(*) >= 2 THEN regr_slope(conf, step) END, 6) + 0.0 AS slope
    FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date) AS step FROM orp) GROUP BY region""",
)


def _trend(source: str, region: str, at: str, y: str) -> tuple[str, str]:
    body = """SELECT region, stamp, step, y, round(b0, 6) + 0.0 AS intercept, round(b1, 6) + 0.0 AS slope,
      CASE WHEN round(b1, 9) > -10 AND round(b1, 9) <= -1 THEN 'sinkend' WHEN round(b1, 9) > -1 AND round(b1, 9) <= 1 THEN 'gleichbleibend'
        WHEN round(b1, 9) > 1 AND round(b1, 9) <= 10 THEN 'steigend' END AS trend
    FROM tail JOIN (SELECT region, CASE WHEN count(*) >= 2 THEN regr_intercept(y, step) END AS b0,
      CASE WHEN count(*) >= 2 THEN regr_slope(y, step) END AS b1 FROM tail GROUP BY region) USING (region)"""
    extra = f"""tail AS (SELECT region, stamp, y, CAST(row_number() OVER (PARTITION BY region ORDER BY stamp) AS INTEGER) AS step FROM (
      SELECT {region} AS region, {at} AS stamp, {y} AS y FROM {source}
      QUALIFY row_number() OVER (PARTITION BY {region} ORDER BY {at} DESC) <= 10))"""
    return body, extra


sql("trend_class", *_trend("en", "region", "date", "last_7"))
sql("trend_class_district", *_trend("oe", "region", "date", "last_7"))
sql("trend_class_snapshots", *_trend("(SELECT * FROM he WHERE district NOT LIKE '%esamt%')", "district", '"update"', "last7"))
sql(
    "weekday_box",
    """SELECT region, weekday, count(*) AS n, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
      min(conf_1) FILTER (WHERE inside) AS whisker_low, max(conf_1) FILTER (WHERE inside) AS whisker_high,
      coalesce(string_agg(CAST(CAST(conf_1 AS BIGINT) AS VARCHAR), ';' ORDER BY conf_1) FILTER (WHERE NOT inside), '') AS outliers
    FROM (SELECT b.*, q1, median, q3, conf_1 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM b JOIN (SELECT region, weekday, quantile_cont(conf_1, 0.25) AS q1, quantile_cont(conf_1, 0.5) AS median,
        quantile_cont(conf_1, 0.75) AS q3 FROM b GROUP BY 1, 2) USING (region, weekday))
    GROUP BY 1, 2""",
    "b AS (SELECT region, weekday, conf_1 FROM enl WHERE conf_1 > 0 AND NOT (region = 'C3' AND date = DATE '2024-01-13'))",
)
sql("category_order", "SELECT district, level, row_number() OVER (ORDER BY level, district) AS ord FROM (SELECT district, quantile_cont(last7, 0.5) AS level FROM he GROUP BY 1)")
sql("category_order_max", "SELECT district, level, row_number() OVER (ORDER BY level, district) AS ord FROM (SELECT district, max(incidence) AS level FROM he GROUP BY 1)")

# Windows
sql("diff_default0", "SELECT region, date, conf_1, dea_1, rec_1 FROM en")
sql("diff_null", "SELECT region, date, conf - lag(conf) OVER (PARTITION BY region ORDER BY date) AS conf_1 FROM cp")
sql(
    "lag_delays",
    """SELECT region, date, conf_1_shift AS conf_7, conf_1_shift_alt AS conf_10, dea_1_shift AS dea_13,
      lag(rec_1, 13, 0) OVER w AS rec_13, lag(conf, 20, 0) OVER w AS conf_total_20 FROM en WINDOW w AS (PARTITION BY region ORDER BY date)""",
)
sql("diff7", "SELECT region, date, conf - lag(conf, 7, 0) OVER (PARTITION BY region ORDER BY date) AS last_7 FROM orp")
sql(
    "running_sum_strict",
    """SELECT region, date, x, CASE WHEN bool_or(x IS NULL) OVER w THEN NULL ELSE sum(x) OVER w END AS total FROM (
      SELECT region, date, CASE WHEN CAST(conf AS BIGINT) % 7 = 0 AND day(date) > 20 THEN NULL ELSE conf_1 END AS x FROM en)
    WINDOW w AS (PARTITION BY region ORDER BY date)""",
)
sql("adjusted_cfr", "SELECT region, date, cfr_adv FROM en")
sql("lead_growth", "SELECT region, date, lead(conf) OVER (PARTITION BY region ORDER BY date) / nullif(conf, 0) - 1 AS g FROM cp")
CTE["ratep"] = "SELECT region, date, conf_1 / nullif(lag(active) OVER (PARTITION BY region ORDER BY date), 0) AS g FROM en"
CTE["growthp"] = "SELECT region, date, lead(conf) OVER (PARTITION BY region ORDER BY date) / nullif(conf, 0) - 1 AS g FROM cp"
sql("rate_per_active", "SELECT region, date, g FROM ratep")
sql("doubling_time_rows", "SELECT region, date, doubling FROM en")
sql("quality_flag", "SELECT region, date, est_quality FROM en")


def _loess(source: str, span: float, grid: bool = False) -> tuple[str, str]:
    """Brute force: every vertex is compared with every point of its series."""
    extra = f"""
pts AS (SELECT region, date, CAST(date - DATE '1970-01-01' AS DOUBLE) AS x, g FROM ({source}) WHERE g IS NOT NULL),
srt AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY x) AS i, count(*) OVER (PARTITION BY region) AS n FROM pts),
prm AS (SELECT region, n, least(n, CAST(floor(n * {span}e0 + 1e-5) AS BIGINT)) AS near,
    greatest(1, CAST(floor(n * {span}e0 * 0.2e0) AS BIGINT)) AS lim, min(x) AS x1, max(x) AS xn FROM srt GROUP BY region, n),
cells AS (SELECT region, CAST(1 AS BIGINT) AS lo, n AS hi, lim FROM prm
  UNION ALL SELECT region, CASE WHEN half = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN half = 0 THEN (lo + hi) // 2 ELSE hi END, lim
  FROM cells, (VALUES (0), (1)) t(half) WHERE hi - lo + 1 > lim),
verts AS (SELECT c.region, (a.x + b.x) / 2 AS v FROM cells c JOIN srt a ON a.region = c.region AND a.i = c.hi
    JOIN srt b ON b.region = c.region AND b.i = c.hi + 1 WHERE c.hi - c.lo + 1 <= c.lim
  UNION ALL SELECT region, x1 - 0.005e0 * greatest(xn - x1, greatest(abs(x1), abs(xn)) * 1e-3 + 1e-30) FROM prm
  UNION ALL SELECT region, xn + 0.005e0 * greatest(xn - x1, greatest(abs(x1), abs(xn)) * 1e-3 + 1e-30) FROM prm),
dist AS (SELECT v.region, v.v, s.x, s.g, p.near, abs(s.x - v.v) AS d, row_number() OVER (PARTITION BY v.region, v.v ORDER BY abs(s.x - v.v)) AS r
  FROM verts v JOIN srt s ON s.region = v.region JOIN prm p ON p.region = v.region WHERE p.near >= 4),
reach AS (SELECT region, v, max(d) AS h FROM dist WHERE r <= near GROUP BY 1, 2),
wts AS (SELECT region, v, h, (x - v) / h AS u, g, power(1 - power(abs((x - v) / h), 3), 3) AS w FROM dist JOIN reach USING (region, v) WHERE d < h),
sums AS (SELECT region, v, h, count(*) AS m, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3,
    sum(w * u * u * u * u) AS s4, sum(w * g) AS t0, sum(w * u * g) AS t1, sum(w * u * u * g) AS t2 FROM wts GROUP BY 1, 2, 3),
dets AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM sums),
fits AS (SELECT region, v,
    CASE WHEN m >= 3 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / nullif(det, 0) END AS b,
    CASE WHEN m >= 3 THEN (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / nullif(det, 0) END / h AS d FROM dets),
pieces AS (SELECT region, v AS v0, b AS b0, d AS d0, lead(v) OVER w AS v1, lead(b) OVER w AS b1, lead(d) OVER w AS d1 FROM fits
  WINDOW w AS (PARTITION BY region ORDER BY v)),
whereto AS ({"SELECT region, x1 + (xn - x1) / 79 * k AS x FROM prm, range(0, 80) t(k)" if grid else "SELECT region, date, x, g FROM pts"}),
placed AS (SELECT a.*, (a.x - v0) / (v1 - v0) AS t, v1 - v0 AS width, b0, b1, d0, d1
  FROM whereto a LEFT JOIN pieces p ON p.region = a.region AND a.x >= v0 AND a.x < v1)"""
    fit = """round((1 - t) * (1 - t) * (1 + 2 * t) * b0 + t * t * (3 - 2 * t) * b1
      + (t * (1 - t) * (1 - t) * d0 - t * t * (1 - t) * d1) * width, 6) + 0.0 AS fit FROM placed"""
    return ("SELECT region, round(x, 6) + 0.0 AS x, " if grid else "SELECT region, date, g, ") + fit, extra


_GROWTH = "SELECT * FROM growthp WHERE g BETWEEN 0 AND 1"
sql("loess_growth", *_loess(_GROWTH, 0.5))
sql("loess_rate", *_loess("SELECT * FROM ratep", 0.2))
sql("loess_curve", *_loess(_GROWTH, 0.5, grid=True))
sql("report_growth", *_loess(_GROWTH + " AND region IN (SELECT region FROM picked)", 0.5))
sql("report_rate", *_loess("SELECT * FROM ratep WHERE region IN (SELECT region FROM picked)", 0.2))

# Long series
_LINES = """lines AS (SELECT l_returnflag, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x FROM lineitem)"""
_LINE_ORDER = "PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, x"
sql(
    "series_blocks",
    f"""SELECT *, x - lag(x, 1, 0) OVER w AS change, x - lag(x) OVER w AS change_null, lag(x, 20, 0) OVER w AS shift_20, x - lag(x, 7, 0) OVER w AS change_7,
      lag(x, 13, 0) OVER w - lag(x, 14, 0) OVER w AS delayed, lead(x) OVER w / nullif(x, 0) - 1 AS growth FROM lines WINDOW w AS ({_LINE_ORDER})""",
    _LINES,
)
sql(
    "running_blocks",
    f"""SELECT *, sum(x) OVER w AS total, CASE WHEN NOT bool_or(y IS NULL) OVER w THEN sum(y) OVER w END AS strict, sum(y) OVER w AS loose
    FROM (SELECT *, CASE WHEN NOT (l_linenumber = 7 AND year(l_shipdate) > 1995) THEN x END AS y FROM lines)
    WINDOW w AS ({_LINE_ORDER} ROWS UNBOUNDED PRECEDING)""",
    _LINES,
)
sql("adjusted_cfr_blocks", "SELECT region, date, cfr_adv FROM en")
sql(
    "quantiles_spread",
    "SELECT l_returnflag, count(*) AS n, "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {s}), 6) + 0.0 AS {n}" for n, s in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("q99", 0.99)))
    + " FROM lineitem GROUP BY 1",
)
sql(
    "box_outliers_spread",
    """SELECT event_type, count(*) AS n, round(max(value), 6) AS most FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM events GROUP BY 1) USING (event_type) WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""",
)
sql("loess_rate_spread", *_loess("SELECT * FROM ratep", 0.2))

# Panels with missing days
_ACTIVE = f"""act AS (SELECT user_id, {EVENT_DAY} AS date, CAST(count(*) AS DOUBLE) AS n, sum(value) AS value, CAST(max(event_id) AS DOUBLE) AS last_id FROM events GROUP BY 1, 2)"""
sql(
    "gap_fill_days",
    """SELECT *, last_id - lag(last_id, 7, 0) OVER (PARTITION BY user_id ORDER BY date) AS week FROM (
      SELECT g.user_id, g.date, coalesce(a.n, 0) AS n, b.last_id, round(CASE WHEN a.date IS NOT NULL THEN a.value
        ELSE b.value + (c.value - b.value) * (date_diff('day', b.date, g.date) / date_diff('day', b.date, c.date)) END, 6) + 0.0 AS value, a.date IS NULL AS filled
      FROM (SELECT user_id, CAST(unnest(generate_series(min(date), (SELECT max(date) FROM act), INTERVAL 1 DAY)) AS DATE) AS date FROM act GROUP BY 1) g
      LEFT JOIN act a ON a.user_id = g.user_id AND a.date = g.date
      ASOF JOIN act b ON b.user_id = g.user_id AND g.date >= b.date
      ASOF LEFT JOIN act c ON c.user_id = g.user_id AND g.date < c.date)""",
    _ACTIVE,
)
sql(
    "day_offsets",
    """SELECT a.user_id, a.date, a.n, b.n AS n_7, a.last_id - c.last_id AS id_3, d.n AS known_7 FROM act a
    LEFT JOIN act b ON b.user_id = a.user_id AND b.date = a.date - 7 LEFT JOIN act c ON c.user_id = a.user_id AND c.date = a.date - 3
    ASOF LEFT JOIN act d ON d.user_id = a.user_id AND a.date - 7 >= d.date""",
    _ACTIVE,
)

# Order and selection
CTE["users"] = "SELECT user_id, count(*) AS n FROM events GROUP BY 1"
sql("topk_ties", "SELECT * FROM users QUALIFY rank() OVER (ORDER BY n DESC) <= 10")
sql("bottomk_ties", "SELECT * FROM users QUALIFY rank() OVER (ORDER BY n) <= 10")
sql("topn_per_region", "SELECT region, date, conf_1 FROM en QUALIFY rank() OVER (PARTITION BY region ORDER BY conf_1 DESC) <= 3")
sql("last_rows_per_region", "SELECT region, date, conf FROM en QUALIFY row_number() OVER (PARTITION BY region ORDER BY date DESC) <= 10")
sql("pick_from_end", "SELECT region, date, active, conf_1 FROM en QUALIFY row_number() OVER (PARTITION BY region ORDER BY date DESC) = 13")
sql("ordinal_before_filter", "SELECT *, row_number() OVER (ORDER BY n DESC, user_id) AS ordinal FROM users")
sql("sort_preview", "SELECT region, date, conf FROM cp ORDER BY conf DESC, region, date LIMIT 6")
sql("pick_region_list", "SELECT region FROM picked")

# Set operations
sql(
    "union_fill",
    """SELECT region, date, conf, active, NULL AS status FROM en
    UNION ALL SELECT region, max(date), max(conf), NULL, 'Prognose' FROM en GROUP BY region""",
)
sql("union_tagged", "SELECT region, date, conf AS x, 'tested' AS source FROM cp UNION ALL SELECT region, date, dea, 'death' FROM cp")

# Filters
sql(
    "filters_bundle",
    """SELECT region, date, conf_1, weekday FROM en WHERE (region IN ('C1', 'C2', 'C3') AND est_quality = 'mittel')
      OR (region IN ('C4', 'C7') AND conf_1 > 0 AND weekday <> 'Sonntag')""",
)
sql("not_in_keeps_null", "SELECT region, province, date, conf FROM ev WHERE province IS NULL OR province NOT IN ('P25', 'P26', 'P30')")
sql("exclude_cell", "SELECT region, date, conf_1 FROM en WHERE NOT (region = 'C3' AND date = DATE '2024-01-13')")
sql("exclude_cell_list", "SELECT region, date, conf_1 FROM en QUALIFY rank() OVER (PARTITION BY region ORDER BY conf_1 DESC) > 1")
sql("same_weekday", "SELECT region, date, conf FROM cp WHERE isodow(date) = isodow(DATE '2024-01-30')")
sql("two_snapshots", "SELECT * FROM he WHERE CAST(\"update\" AS DATE) IN (DATE '2024-01-30', DATE '2024-01-23')")
sql("regex_filter", "SELECT * FROM he WHERE district NOT LIKE '%esamt%' AND district LIKE '%1%'")
sql("axis_domain", "SELECT region, date, cfr_1 FROM en WHERE cfr_1 BETWEEN 0 AND 0.2 AND doubling > 0")

# Scalar functions
sql(
    "scalars_text",
    """SELECT p_partkey,
      CASE WHEN contains(p_name, ' ') THEN left(p_name, instr(p_name, ' ') - 1) || '$' || substr(p_name, instr(p_name, ' ') + 1) ELSE p_name END AS first_blank,
      replace(replace(p_name || '-' || p_brand, '-', ''), ' ', '') AS stripped,
      p_brand || ' ' || CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE 'NA' END || ' ' || p_type AS pasted,
      substr(p_type, 1, 3) AS head, TRY_CAST(p_brand AS DOUBLE) AS no_number, TRY_CAST(substr(p_brand, 7, 9) AS DOUBLE) AS brand_no,
      1000.5e0 + p_size AS comma
    FROM part""",
)
sql(
    "scalars_num",
    """SELECT o_orderkey, round(CAST(o_custkey AS DOUBLE) / nullif(o_orderkey, 0), 3) AS share_3,
      round_even(CAST(o_custkey AS DOUBLE) * 0.5, 0) AS half_even,
      CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_totalprice > 200000 THEN o_totalprice - 200000 ELSE 0 END END AS clamped,
      CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS filled,
      round(CASE WHEN o_custkey > 0 THEN ln(8) / nullif(ln(o_custkey / 300e0), 0) END, 6) AS doubling,
      round(power(1.05e0, o_custkey % 10), 9) AS power,
      CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_totalprice > 250000 THEN 'mittel' ELSE 'gering' END END AS flag,
      CASE WHEN o_totalprice > 1000 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice > 100000 AND o_totalprice <= 250000 THEN 'middle'
        WHEN o_totalprice > 250000 AND o_totalprice <= 400000 THEN 'high' END AS band
    FROM orders""",
)
sql(
    "scalars_date",
    f"""SELECT o_orderkey, d AS mdy, CAST(NULL AS DATE) AS mdy_bad, d AS ymd, d AS stamp_day, CAST(d + INTERVAL 570 MINUTE AS TIMESTAMP) AS ymd_hms,
      d AS serial, {WEEKDAY.format('d')} AS weekday,
      ['Freitag','Montag','Donnerstag','Dienstag','Mittwoch','Samstag','Sonntag'][isodow(d)] AS weekday_level,
      d + 7 AS week_later, d - 7 AS week_before
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
sql(
    "thousands_repair",
    """SELECT p_partkey, damaged, CASE WHEN trunc(damaged) = damaged THEN damaged ELSE damaged * 1000 END AS repaired FROM (
      SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE (p_size + 1000) / 1000e0 END AS damaged FROM part)""",
)
sql(
    "density_norm",
    """SELECT p_partkey, thousands, p_size / nullif(thousands, 0) / 10 AS per_100 FROM (
      SELECT p_partkey, p_size, p_size / nullif(p_retailprice - 900, 0) * 100 AS thousands FROM part)""",
)

# Composites and reports
sql("enrich_country", "SELECT * FROM en")
sql("enrich_district", "SELECT * FROM oe")


def _current(source: str, rec: bool = True, ordinal: bool = False) -> str:
    cols = ["ordinal"] if ordinal else []
    cols += ["region", "date", "conf AS conf_total", "dea AS dea_total"] + (["rec AS rec_total"] if rec else [])
    cols += ["conf_1 AS conf_day", "dea_1 AS dea_day"] + (["rec_1 AS rec_day"] if rec else [])
    cols += ["round(cfr_1, 3) AS dea_per_conf"] + (["round(cfr_2, 3) AS dea_per_closed"] if rec else [])
    cols += ["round(cfr_adv, 3) AS adv_estimator", "round(doubling, 1) AS doubling_days"]
    return f"SELECT {', '.join(cols)} FROM {source}"


_LAST = "QUALIFY row_number() OVER (PARTITION BY region ORDER BY date DESC) = 1"
sql("report_current", f"{_current('enl')} {_LAST}")
sql(
    "report_published",
    f"""SELECT region, date, conf_total AS "Bestätigte_Gesamt", dea_total AS "Gestorben_Gesamt", rec_total AS "Genesen_Gesamt",
      conf_day AS "Bestätigte_Tag", dea_day AS "Gestorben_Tag", rec_day AS "Genesen_Tag", dea_per_conf AS "Tote_pro_Bestätigte",
      dea_per_closed AS "Tote_pro_Abgeschlossene", adv_estimator AS "Adv_Estimator_2", doubling_days AS "Verdopplungszeit"
    FROM ({_current('enl')} {_LAST})""",
)
sql("report_totals", _labelled("enl", TOTALS))
sql("report_daily", f"SELECT * FROM ({_labelled('enl', CHANGES)}) WHERE NOT (region = 'C3' AND date = DATE '2024-01-13')")
sql("report_active_delta", "SELECT region, date, active_1 AS value FROM enl WHERE NOT (region = 'C3' AND date = DATE '2024-01-13')")
sql(
    "report_estimators",
    " UNION ALL ".join(f"SELECT region, date, '{e}' AS estimator, {e} AS value, est_quality FROM enl" for e in ("cfr_1", "cfr_2", "cfr_adv")),
)


def _trajectory(days: int) -> str:
    return f"""SELECT * FROM ({_current('enl')} QUALIFY rank() OVER (PARTITION BY region ORDER BY date DESC) <= {days})
      WHERE isodow(date) = isodow(DATE '2024-01-30')"""


sql("report_trajectory", _trajectory(42))
sql("report_trajectory_15", f"SELECT * FROM ({_trajectory(15)}) WHERE doubling_days > 0")
sql("report_trajectory_last", f"SELECT * FROM ({_trajectory(42)}) QUALIFY rank() OVER (PARTITION BY region ORDER BY date DESC) = 1")
sql(
    "report_incidence_rank",
    """SELECT name, count, new, per_100k, round(th, 6) AS inhabitants_thousands, round(pp, 6) AS new_per_100,
      row_number() OVER (ORDER BY per_100k, name) AS ord, row_number() OVER (ORDER BY pp, name) AS ord_change
    FROM (SELECT *, new / nullif(th, 0) / 10 AS pp FROM (SELECT *, count / nullif(per_100k, 0) * 100 AS th FROM (
      SELECT l.region AS name, l.conf AS count, l.conf_1 AS new, round(l.conf / p.people * 100000, 1) AS per_100k
      FROM oe_last l JOIN (SELECT n_name, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) p ON p.n_name = l.region)))""",
)
sql(
    "report_two_snapshot",
    """SELECT district, stamp, value, ord FROM two JOIN (SELECT district, row_number() OVER (ORDER BY m, district) AS ord FROM (
      SELECT district, quantile_cont(value, 0.5) AS m FROM two GROUP BY 1)) USING (district)""",
    """two AS (SELECT district, "update" AS stamp, incidence AS value FROM he
      WHERE district <> 'Gesamtergebnis' AND CAST("update" AS DATE) IN (DATE '2024-01-30', DATE '2024-01-23'))""",
)
sql("report_timeline", "SELECT district, \"update\" AS stamp, incidence AS value FROM he WHERE district <> 'Gesamtergebnis'")
sql("report_timeline_named", "SELECT district, \"update\" AS stamp, cumulated AS value FROM he WHERE district LIKE '%- 1%'")
_TWO = {"conf": "Bestätigt", "dea": "Gestorben"}
sql("report_district_top", f"SELECT * FROM ({_labelled('oe', _TWO)}) WHERE region IN (SELECT region FROM oe_top)")
sql("report_district_bottom", f"SELECT * FROM ({_labelled('oe', _TWO)}) WHERE region IN (SELECT region FROM oe_bottom)")
sql("report_district_daily", _labelled("oe", {"conf_1": "Bestätigt", "dea_1": "Gestorben"}))
sql(
    "report_district_table",
    _current(
        """(SELECT *, row_number() OVER (ORDER BY conf DESC, region) AS ordinal FROM oe_last)
        WHERE region IN (SELECT region FROM oe_top) OR region IN (SELECT region FROM oe_bottom)""",
        rec=False,
        ordinal=True,
    ),
)
_RECOVERY = {"conf": "Bestätigt", "dea": "Gestorben", "rec_est_total": "Genesen Prognose", "active_est": "Aktuell Krank Prognose"}
sql(
    "recovery_estimate",
    _labelled("est", _RECOVERY, "round({}, 6) + 0.0"),
    f"""cfr AS ({CFR}),
    est1 AS (SELECT enl.*, (1 - cfr_mean) * lag(conf_1, 20, 0) OVER (PARTITION BY region ORDER BY date) AS rec_est FROM enl JOIN cfr USING (region)),
    est2 AS (SELECT *, CASE WHEN bool_or(rec_est IS NULL) OVER w THEN NULL ELSE sum(rec_est) OVER w END AS rec_est_total FROM est1
      WINDOW w AS (PARTITION BY region ORDER BY date)),
    est AS (SELECT *, conf - dea - rec_est_total AS active_est FROM est2)""",
)
_NEED = "SELECT region, date, status, scenario, rate, round(value, 3) + 0.0 AS value, round_even(value * 0.05, 0) AS need, 27880 AS capacity, 37880 AS capacity_extended FROM"
sql("scenario_exponential", f"{_NEED} fan")
sql(
    "scenario_recurrent",
    f"""{_NEED} (SELECT region, date, 'Beobachtung' AS status, scenario, rate, active AS value FROM en, rates
      UNION ALL SELECT region, CAST(last + CAST(i AS INTEGER) AS DATE), 'Prognose', scenario, rate, a FROM steps WHERE i > 0)""",
    """hist AS (SELECT region, max(date) AS last, list(conf_1 ORDER BY date) AS c, last(active ORDER BY date) AS a
      FROM (SELECT * FROM en QUALIFY row_number() OVER (PARTITION BY region ORDER BY date DESC) <= 13) GROUP BY region HAVING count(*) = 13),
    steps AS (SELECT region, last, scenario, rate, 0 AS i, a, c FROM hist, rates
      UNION ALL SELECT region, last, scenario, rate, i + 1, CASE WHEN a * (1 + rate) - c[1] > 0 THEN a * (1 + rate) - c[1] WHEN a * (1 + rate) - c[1] <= 0 THEN 0 END,
        list_append(c[2:13], a * rate) FROM steps WHERE i < 50)""",
)
sql(
    "ratio_two_dims",
    """SELECT 'Alter ' || l_linenumber AS band, CASE l_returnflag WHEN 'A' THEN 'weiblich' ELSE 'männlich' END AS sex, tested, death, death / nullif(tested, 0) AS ratio
    FROM (SELECT l_linenumber, l_returnflag, """
    + ", ".join(
        f"CASE WHEN {n} < 1000 OR {n} % 1000 = 0 THEN CASE WHEN {n} < 1000 THEN CAST({n} AS DOUBLE) ELSE {n} / 1000e0 END ELSE {n} / 1000e0 * 1000 END AS {name}"
        for n, name in (("t", "tested"), ("d", "death"))
    )
    + """ FROM (SELECT l_linenumber, l_returnflag, count(*) AS t, count(*) FILTER (WHERE l_linestatus = 'F') AS d FROM lineitem
      WHERE l_returnflag IN ('A', 'N') AND l_linenumber <> 7 GROUP BY 1, 2))""",
)
sql(
    "ratio_by_band",
    """SELECT CASE WHEN f > 0 AND f <= 500 THEN '(0,500]' WHEN f > 500 AND f <= 750 THEN '(500,750]' WHEN f > 750 AND f <= 1500 THEN '(750,1.5e+03]' END AS band,
      count(*) AS districts, CAST(coalesce(sum(r), 0) AS DOUBLE) / nullif(CAST(coalesce(sum(n), 0) AS DOUBLE), 0) AS ratio
    FROM (SELECT round((p_retailprice - 900) * 16, 1) AS f, n, r FROM part LEFT JOIN (
      SELECT l_partkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_partkey = p_partkey) GROUP BY 1""",
)
sql("freshness", 'SELECT max("update") AS updated FROM he')
