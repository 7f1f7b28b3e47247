"""Metrics, rankings, trends, projections on small worked cases."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from daypanel.functions import try_div, cumsum_strict
from daypanel.operators import filters, joins, projection, reshape, select, stats, windows
from daypanel.operators.metrics import PanelSpec, add_metrics, aggregate_panel, enrich_panel, recovery_estimate

DAY = dt.date(2020, 4, 1)


def day(i):
    return DAY + dt.timedelta(days=i - 1)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert (a is None) == (b is None), (got, want)
        assert a is None or a == pytest.approx(b, abs=1e-6), (got, want)


@pytest.fixture(scope="module")
def worked(spark):
    conf = [10, 20, 40, 80, 80, 60]
    dea = [0, 1, 2, 4, 5, 5]
    rec = [0, 0, 5, None, 20, 30]
    data = [("R", day(i + 1), float(c), float(d), None if r is None else float(r)) for i, (c, d, r) in enumerate(zip(conf, dea, rec))]
    random.Random(1).shuffle(data)
    panel = spark.createDataFrame(data, "region string, date date, conf double, dea double, rec double")
    return add_metrics(panel, PanelSpec(death_rows=2)).orderBy("date").cache()


def column(df, name):
    return [r[name] for r in df.select("date", name).orderBy("date").collect()]


def test_worked_series(worked):
    close(column(worked, "conf_1"), [10, 10, 20, 40, 0, -20])
    close(column(worked, "dea_1"), [0, 1, 1, 2, 1, 0])
    close(column(worked, "rec_1"), [0, 0, 5, None, None, 10])
    close(column(worked, "active"), [10, 19, 33, None, 55, 25])
    close(column(worked, "active_1"), [10, 9, 14, None, None, -30])
    close(column(worked, "cfr_1"), [0, 0.05, 0.05, 0.05, 0.0625, 0.083333])
    close(column(worked, "cfr_2"), [None, 1, 0.285714, None, 0.2, 0.142857])
    close(column(worked, "cfr_adv"), [None, None, 0.2, 0.2, 0.125, 0.0625])
    close(column(worked, "doubling"), [None, None, None, 1, 1.5, 5.128534])
    assert set(column(worked, "est_quality")) == {"gering"}


def test_worked_windows(worked):
    w = windows.series()
    got = worked.select(
        "date",
        cumsum_strict("rec_1", w).alias("total"),
        windows.lead_growth("conf", w).alias("g"),
        windows.rate_per_previous("conf_1", "active", w).alias("r"),
    )
    close(column(got, "total"), [0, 0, 5, None, None, None])
    close(column(got, "g"), [1, 1, 1, 0, -0.25, None])
    close(column(got, "r"), [None, 1, 1.052632, 1.212121, None, -0.363636])


def test_shifted_change_equals_nested_lags(spark):
    data = [("R", day(i), float(v) if v is not None else None) for i, v in enumerate([3, 5, None, 9, 12, 11, 20, 25, 31, 40], 1)]
    df = spark.createDataFrame(data, "region string, date date, x double")
    w = windows.series()
    nested = df.withColumn("d", windows.change("x", w)).withColumn("n", windows.shift("d", 3, w))
    got = nested.withColumn("s", windows.shifted_change("x", 3, w)).orderBy("date").collect()
    assert [r["n"] for r in got] == [r["s"] for r in got]


def test_sub_regions_with_a_gap(spark, rows):
    df = spark.createDataFrame(
        [("X", day(1), 1.0, 1.0, None), ("X", day(1), 2.0, 0.0, 4.0), ("X", day(2), 3.0, 0.0, 1.0)],
        "region string, date date, conf double, dea double, rec double",
    )
    assert rows(aggregate_panel(df)) == [("X", day(1), 3.0, 1.0, None), ("X", day(2), 3.0, 0.0, 1.0)]


def test_two_measure_panel(spark):
    df = spark.createDataFrame([("X", day(1), 4.0, 1.0)], "k string, d date, c double, t double")
    got = enrich_panel(df, PanelSpec("k", "d", "c", "t", None))
    assert "active" not in got.columns and got.first()["last_7"] == 4.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=25))
def test_running_sums_telescope(spark, values):
    df = spark.createDataFrame([("R", day(i), float(v), 0.0, 0.0) for i, v in enumerate(values, 1)], "region string, date date, conf double, dea double, rec double")
    w = windows.series()
    got = add_metrics(df).select("date", "conf", cumsum_strict("conf_1", w).alias("a"), cumsum_strict("conf_1_shift", w).alias("b")).orderBy("date").collect()
    assert [r["a"] for r in got] == values
    assert [r["b"] for r in got] == ([0.0] * 7 + values)[: len(values)]


def test_ties_are_kept(spark, rows):
    df = spark.createDataFrame([("a", 9), ("b", 7), ("c", 7), ("d", 5), ("e", None)], "k string, w int")
    assert rows(select.top_k_ties(df, 2, "w").select("k")) == [("a",), ("b",), ("c",)]
    assert rows(select.bottom_k_ties(df, 2, "w").select("k")) == [("b",), ("c",), ("d",)]
    assert select.top_k_ties(df, 99, "w").count() == 4
    assert select.top_k_ties(df.where("w > 100"), 2, "w").count() == 0


def test_top_n_per_group(spark, rows):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 5), ("x", 3, 1), ("y", 1, 2), ("y", 2, None)], "k string, i int, w int")
    assert rows(select.top_n_per(df, "k", 1, "w").select("k", "i")) == [("x", 1), ("x", 2), ("y", 1)]
    assert rows(select.last_rows(df, "k", 2, "i").select("k", "i")) == [("x", 2), ("x", 3), ("y", 1), ("y", 2)]
    assert rows(select.last_per_group(df, "k", "i")) == [("x", 3, 1), ("y", 2, None)]


def test_region_list(spark, rows):
    df = spark.createDataFrame([(r, day(d), float(v)) for r, d, v in [("a", 1, 99), ("a", 2, 5), ("b", 1, 1), ("b", 2, 8), ("c", 2, 8), ("d", 2, 1)]], "region string, date date, conf double")
    listed = select.pick_regions(df, 1, manual=("b", "d", "none"))
    assert rows(listed) == [("b",), ("b",), ("c",), ("d",)]
    assert joins.keep_listed(df, listed, "region").count() == 4
    assert rows(select.pick_regions(df, 1, largest=False)) == [("d",)]


@pytest.mark.parametrize("descending", [False, True])
def test_ordinals_with_a_hot_value(spark, descending):
    rnd = random.Random(7)
    data = [(f"k{i:05d}", 3.0 if i % 2 else (None if i % 97 == 0 else float(rnd.randint(0, 50)))) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r["ordinal"] for r in select.global_row_number(df, "v", "k", descending=descending).collect()}
    want = sorted(data, key=lambda r: (r[1] is None, 0 if r[1] is None else (-r[1] if descending else r[1]), r[0]))
    assert got == {k: i for i, (k, _) in enumerate(want, 1)}


def test_ordinals_where_all_tie(spark):
    df = spark.range(20000).select(F.lit(1.0).alias("v"), F.col("id").alias("k"))
    plan_rows = select.global_row_number(df, "v", "k")
    assert plan_rows.agg(F.max("ordinal"), F.countDistinct("ordinal")).first()[:] == (20000, 20000)


def test_linear_fit(spark, rows):
    df = spark.createDataFrame([("up", 1, 1.0), ("up", 2, 3.0), ("up", 3, 5.0), ("flat", 1, 4.0), ("flat", 2, 4.0), ("one", 1, 2.0)], "k string, x int, y double")
    assert rows(stats.linear_fit(df, "k", "y", "x").select("k", "intercept", "slope").distinct()) == [
        ("flat", 4.0, 0.0), ("one", None, None), ("up", -1.0, 2.0),
    ]
    assert rows(stats.linear_fit_summary(df, "k", "y", "x")) == [("flat", 4.0, 0.0), ("one", None, None), ("up", -1.0, 2.0)]


def test_trend_classes(spark):
    slopes = {"fall": -2, "flat": 1, "rise": 10, "steep": 11, "plunge": -10}
    data = [(k, day(i), float(s * i + (1000 if i <= 5 else 0))) for k, s in slopes.items() for i in range(1, 16)]
    df = spark.createDataFrame(data, "region string, date date, y double")
    got = {r["region"]: r["trend"] for r in stats.trend_class(df, "region", "date", "y").collect()}
    assert got == {"fall": "sinkend", "flat": "gleichbleibend", "rise": "steigend", "steep": None, "plunge": None}


def test_box(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 10.0, None)], "k string, y double")
    r = stats.box_stats(df, ["k"], "y").first()
    assert tuple(r) == ("a", 4, 1.75, 2.5, 4.75, 1.0, 3.0, [10.0])


def test_category_order(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 2.0), ("c", 2.0), ("d", None)], "k string, y double")
    assert rows(stats.order_by_aggregate(df, "k", "y", "max").select("k", "ord")) == [("a", 3), ("b", 1), ("c", 2), ("d", 4)]
    assert rows(stats.order_by_aggregate(df, "k", "y").select("k", "ord")) == [("a", 3), ("b", 1), ("c", 2), ("d", 4)]


def history(n, region="R"):
    return [(region, day(i), 50.0, float(10 * i)) for i in range(1, n + 1)]


def test_recurrence(spark):
    df = spark.createDataFrame(history(13), "region string, date date, active double, conf_1 double")
    got = projection.recurrent_steps(df, rates=(0.10,), horizon=5).orderBy("i").collect()
    close([r["active"] for r in got], [45, 29.5, 2.45, 0, 0])
    close([r["new"] for r in got], [5, 4.5, 2.95, 0.245, 0])
    assert [r["date"] for r in got] == [day(14 + i) for i in range(5)]


def test_recurrence_needs_history(spark):
    df = spark.createDataFrame(history(12), "region string, date date, active double, conf_1 double")
    assert projection.recurrent_steps(df).count() == 0
    assert projection.recurrent_fan(df).where("status = 'Prognose'").count() == 0


def test_recurrence_uses_the_last_rows_only(spark):
    data = [("R", day(i - 30), 1.0, 999.0) for i in range(1, 31)] + history(13)
    df = spark.createDataFrame(data, "region string, date date, active double, conf_1 double")
    got = projection.recurrent_steps(df, rates=(0.10,), horizon=5).orderBy("i").collect()
    close([r["active"] for r in got], [45, 29.5, 2.45, 0, 0])


def test_recurrence_without_growth_or_history_is_constant(spark):
    df = spark.createDataFrame([("R", day(i), 50.0, 0.0) for i in range(1, 14)], "region string, date date, active double, conf_1 double")
    assert {r["active"] for r in projection.recurrent_steps(df, rates=(0.0,), horizon=20).collect()} == {50.0}


def test_recurrence_with_a_missing_value(spark):
    data = history(13)[:-1] + [("R", day(13), None, 130.0)]
    df = spark.createDataFrame(data, "region string, date date, active double, conf_1 double")
    assert {r["active"] for r in projection.recurrent_steps(df, rates=(0.1,), horizon=3).collect()} == {None}


def test_exponential_fan(spark):
    df = spark.createDataFrame([("R", day(1), 200.0), ("R", day(2), 100.0)], "region string, date date, conf double")
    fan = projection.exponential_fan(df, rates=(0.5,), horizon=2).orderBy("date").collect()
    assert [(r["date"], r["status"], r["value"], r["need"]) for r in fan] == [
        (day(1), "Beobachtung", 200.0, 10.0), (day(2), "Beobachtung", 100.0, 5.0),
        (day(3), "Prognose", 300.0, 15.0), (day(4), "Prognose", 450.0, 22.0),
    ]
    assert (fan[0]["capacity"], fan[0]["capacity_extended"]) == (27880, 37880)


def test_recovery_estimate(spark):
    df = spark.createDataFrame([("R", day(i), float(i), 0.0, 1.0) for i in range(1, 24)], "region string, date date, conf double, dea double, conf_1 double")
    cfr = spark.createDataFrame([("R", 0.25)], "region string, cfr_mean double")
    got = recovery_estimate(df, cfr).orderBy("date").collect()
    close([r["rec_est_total"] for r in got][18:], [0, 0, 0.75, 1.5, 2.25])
    close([got[-1]["active_est"]], [23 - 2.25])


def test_exclude_cells_keeps_missing(spark):
    df = spark.createDataFrame([("China", day(1)), ("China", day(2)), (None, day(1)), ("China", None)], "region string, date date")
    assert filters.exclude_cells(df, [("China", day(1))]).count() == 3


def test_null_safe_and_natural_joins(spark, rows):
    left = spark.createDataFrame([(None, "X", 1.0, 5), ("P", "X", 1.0, 6), ("Q", "X", 1.0, 7)], "p string, c string, lat double, a int")
    right = spark.createDataFrame([(None, "X", 1.0, 50), ("P", "X", 2.0, 60)], "p string, c string, lat double, b int")
    assert rows(joins.join_null_safe(left, right.drop("lat"), ["p", "c"]).select("a", "b")) == [(5, 50), (6, 60), (7, None)]
    assert rows(joins.join_natural(left, right).select("a", "b")) == [(5, 50), (6, None), (7, None)]
    assert joins.join_null_safe(left, right, ["p", "c"]).columns == ["p", "c", "lat", "a", "lat_right", "b"]
    both = joins.join_suffixed(left.drop("p"), left.drop("p", "lat"), ["c"], ("_1", "_2"))
    assert both.columns == ["c", "lat", "a_1", "a_2"]


def test_unpivot_and_pivot(spark, rows):
    df = spark.createDataFrame([("x", 1.0, None), ("y", 3.0, 4.0)], "k string, a double, b double")
    long = reshape.unpivot_rest(df, 1, "m", "v")
    assert long.count() == 4
    assert rows(reshape.pivot_declared(long, ["k"], "m", "v", ["a", "b"], unique=True)) == rows(df)
    many = [f"c{i}" for i in range(20)]
    wide = df.select("k", *[(F.col("a") + i).alias(c) for i, c in enumerate(many)])
    assert rows(reshape.pivot_declared(reshape.unpivot_rest(wide, 1, "m", "v"), ["k"], "m", "v", many, unique=True)) == rows(wide)


@pytest.mark.parametrize("n", [2, 20])
def test_pivot_reports_duplicates(spark, n):
    df = spark.createDataFrame([("x", "c0", 1.0), ("x", "c0", 2.0)], "k string, m string, v double")
    with pytest.raises(Exception, match="duplicate cell"):
        reshape.pivot_declared(df, ["k"], "m", "v", [f"c{i}" for i in range(n)], unique=True).collect()


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert reshape.select_range(df, 1, "c", "d").columns == ["a", "c", "d"]
    assert reshape.rename_positions(df, {2: "x"}).columns == ["a", "x", "c", "d"]
    assert tuple(reshape.map_columns(df, lambda c: c * 10, exclude=("a", "d")).first()) == (1, 20, 30, 4)
    assert reshape.union_fill(df.drop("d"), df).where("d is null").count() == 1
    assert {r["source"] for r in reshape.union_tagged({"p": df, "q": df}).collect()} == {"p", "q"}


def test_row_order_does_not_matter(spark, rows):
    rnd = random.Random(3)
    data = [(f"R{r}", day(d), float(rnd.randint(0, 90)), float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for r in range(4) for d in range(1, 21)]
    schema = "region string, date date, conf double, dea double, rec double"
    first = rows(enrich_panel(spark.createDataFrame(data, schema)))
    rnd.shuffle(data)
    assert rows(enrich_panel(spark.createDataFrame(data, schema).repartition(7))) == first


@pytest.mark.parametrize("many", [2, 20])
def test_pivot_names_do_not_depend_on_their_number(spark, many):
    values = [1e10, 2.0, *[float(i) + 0.5 for i in range(many - 2)]]
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate(values)], "k string, v double, x int")
    wide = reshape.pivot_declared(df, ["k"], "v", "x", values)
    assert wide.columns == ["k", *map(str, values)]
    assert wide.first()[1:] == tuple(range(many))


def test_quantiles_are_those_of_numpy(spark):
    rnd = random.Random(2)
    data = [(k, None if rnd.random() < 0.1 else rnd.choice([1.0, 2.0, rnd.random()])) for k in "abc" for _ in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(data + [("d", None)], "k string, y double")
    got = {r.k: r for r in stats.quantiles(df, ["k"], "y", {"lo": 0.25, "mid": 0.5, "hi": 0.9}).collect()}
    for k in "abc":
        ys = [y for g, y in data if g == k and y is not None]
        assert got[k].n == len(ys)
        assert [got[k].lo, got[k].mid, got[k].hi] == pytest.approx(list(np.quantile(ys, [0.25, 0.5, 0.9])))
    outside = stats.box_outliers(df, ["k"], "y").count()
    assert outside == sum(len(r.outliers) for r in stats.box_stats(df, ["k"], "y").collect())
