"""Windows and quantiles by blocks against the plain ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from daypanel.functions.missing import cumsum_strict
from daypanel.operators import blocks, loess, metrics, stats, windows
from daypanel.operators.blocks import Blocks, placed
from daypanel.session import stage

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    """Series of very different lengths, a missing region, missing values, in no order."""
    rng = random.Random(3)
    rows = []
    for region, n in (("A", 400), ("B", 1), (None, 37), ("C", 16), ("D", 17), ("", 3)):
        total = [0.0, 0.0, 0.0]
        for i in range(n):
            total = [t + rng.randrange(30) for t in total]
            conf, dea, rec = total
            rows.append((region, DAY + dt.timedelta(days=i), conf, None if region == "C" and i == 9 else dea, None if i % 50 == 49 else rec))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "region string, date date, conf double, dea double, rec double").repartition(5)


def columns(w):
    return {
        "a": windows.change("conf", w), "b": windows.change_or_null("rec", w), "c": windows.shift("conf", 5, w), "d": windows.shifted_change("dea", 6, w),
        "e": windows.lead_growth("conf", w), "f": F.lead("rec", 7).over(w), "g": windows.rate_per_previous("conf", "dea", w),
    }


@pytest.mark.parametrize("size", [8, 16, 100, 10_000])
def test_offsets_equal_plain_windows(panel, rows, size):
    blocked = Blocks.of(panel, size=size).with_offsets(columns, back=7, ahead=7).frame()
    assert rows(blocked) == rows(panel.withColumns(columns(windows.series())))


@pytest.mark.parametrize("size", [1, 8, 10_000])
def test_running_sums_equal_plain_windows(panel, rows, size):
    blocked = Blocks.of(panel, size=size).with_running({"s": "dea", "t": "rec"}).with_running({"u": "rec"}, strict=False).frame()
    w = windows.series()
    plain = panel.withColumns({"s": cumsum_strict("dea", w), "t": cumsum_strict("rec", w), "u": F.sum("rec").over(w)})
    assert rows(blocked) == rows(plain)


@pytest.mark.parametrize("size", [14, 64])
def test_metrics_equal_plain_metrics(panel, rows, size):
    assert rows(metrics.add_metrics_blocked(panel, size=size)) == rows(metrics.add_metrics(panel))
    two = metrics.PanelSpec(rec=None)
    assert rows(metrics.add_metrics_blocked(panel.drop("rec"), two, size=size)) == rows(metrics.add_metrics(panel.drop("rec"), two))


def test_offsets_beyond_a_block_are_refused(panel):
    with pytest.raises(ValueError):
        Blocks.of(panel, size=4).with_offsets(lambda w: {"x": F.lag("conf", 5).over(w)}, back=5)


def test_places_with_ties_and_weights(spark, rows):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", 0, 1), (None, 5, 4), ("a", 1, 3), ("b", None, 1)], "k string, x int, w int").repartition(3)
    got = placed(df, ["k"], ["x"])
    assert sorted((r.k or "", r._pos, r._n) for r in got.collect()) == [("", 0, 1), ("a", 0, 4), ("a", 1, 4), ("a", 2, 4), ("a", 3, 4), ("b", 0, 1)]
    weighted = placed(df.where("k = 'a'"), ["k"], ["x", "w"], weight="w").collect()
    assert sorted((r._pos, r.x, r.w, r._n) for r in weighted) == [(0, 0, 1, 9), (1, 1, 2, 9), (3, 1, 3, 9), (6, 1, 3, 9)]
    assert placed(df.limit(0), ["k"], ["x"]).collect() == []


def test_a_long_series_spreads_over_tasks(spark):
    """Three quarters of the rows are one series: no task of the window gets more than its blocks."""
    df = spark.range(400_000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 100)).alias("region"), F.col("id").alias("date"), (F.col("id") % 7).cast("double").alias("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        long = Blocks.of(df, size=2_000).with_offsets(lambda w: {"y": windows.change("x", w)}, back=1).with_running({"s": "x"})
        out = long.frame().withColumn("part", F.spark_partition_id())
        sizes = sorted(r["n"] for r in out.groupBy("part").agg(F.count("y").alias("n"), F.sum("s")).collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
        hot = long.frame().where("region = 'hot'")
        w = Window.partitionBy("region").orderBy("date")
        plain = df.where("region = 'hot'").select("date", windows.change("x", w).alias("y"), F.sum("x").over(w).alias("s"))
        assert hot.select("date", "y", "s").exceptAll(plain).count() == 0 and hot.count() == plain.count() == 300_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("spread", [True, False])
def test_quantiles_are_exact(spark, spread):
    import numpy as np

    rng = np.random.default_rng(4)
    groups = {"hot": rng.normal(size=3000).round(2), "one": np.array([5.0]), "same": np.full(700, 3.0), "two": np.array([1.0, 2.0]), None: rng.integers(0, 4, 400).astype(float)}
    data = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(data, "k string, y double").repartition(6)
    shares = {"q0": 0.0, "q1": 0.25, "mid": 0.5, "q9": 0.9, "q1000": 1.0}
    got = {r.k: r for r in stats.quantiles(df, ["k"], "y", shares, spread).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs)
        for name, share in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, share), abs=1e-12)
    assert stats.quantiles(df.limit(0), ["k"], "y", shares, spread).collect() == []


def test_quantiles_of_a_hot_group_spread_over_tasks(spark, monkeypatch):
    """Half of all rows in one group: the range partitions that its values are placed in are even."""
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("k"), F.hash("id").cast("double").alias("y"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        written = []
        monkeypatch.setattr(blocks, "stage", lambda *a: written.append(stage(*a)) or written[-1])
        placed(df, ["k"], ["y"])
        sizes = sorted(r["count"] for r in written[0].groupBy(F.input_file_name().alias("f")).count().collect())
        assert len(sizes) >= 14 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        a = stats.quantiles(df, ["k"], "y", {"m": 0.5, "p": 0.99})
        assert a.exceptAll(stats.quantiles(df, ["k"], "y", {"m": 0.5, "p": 0.99}, spread=False)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("span", [0.2, 0.5, 1.0])
def test_smoother_of_long_series_equals_the_array_one(spark, span):
    rng = random.Random(8)
    data = []
    for key, n in (("long", 700), ("short", 9), ("tiny", 3), ("gap", 60)):
        xs = rng.sample(range(5 * n), n)
        data += [(key, float(x + (10_000 if key == "gap" and x > 150 else 0)), rng.random() if rng.random() < 0.95 else None) for x in xs]
    df = spark.createDataFrame(data, "k string, x double, y double").repartition(4)
    one, two = (
        {(r.k, r.x): r.fit for r in loess.loess_fit(df, "k", "x", "y", span, spread=s).collect()} for s in (False, True)
    )
    assert one.keys() == two.keys()
    for at, fit in one.items():
        assert two[at] == (fit if fit is None else pytest.approx(fit, rel=1e-9, abs=1e-9))
    grids = [sorted((r.k, r.x, r.fit) for r in loess.loess_grid(df, "k", "x", "y", span, points=20, spread=s).where("fit is not null").collect()) for s in (False, True)]
    assert len(grids[0]) == len(grids[1]) > 0
    assert all(a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9, abs=1e-9) for a, b in zip(*grids))
