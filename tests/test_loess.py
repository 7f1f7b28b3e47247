"""The smoother against a direct fit, written with numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.operators.loess import loess_fit, loess_grid


def direct(x, y, span, at):
    """Weighted quadratic at one position: value and slope."""
    q = min(len(x), int(math.floor(len(x) * span + 1e-5)))
    d = np.abs(x - at)
    h = np.sort(d)[q - 1]
    w = np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0)
    c = np.polyfit((x - at)[w > 0], y[w > 0], 2, w=np.sqrt(w[w > 0]))
    return c[2], c[1]


def cuts(n, limit):
    out, todo = [], [(1, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 > limit:
            mid = (lo + hi) // 2
            out.append(mid)
            todo += [(lo, mid), (mid + 1, hi)]
    return sorted(out)


def blended(x, y, span, at):
    n = len(x)
    pad = 0.005 * max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    places = [x[0] - pad] + [(x[c - 1] + x[c]) / 2 for c in cuts(n, max(1, int(n * span * 0.2)))] + [x[-1] + pad]
    fits = [direct(x, y, span, p) for p in places]
    out = []
    for a in at:
        i = min(max(np.searchsorted(places, a, side="right") - 1, 0), len(places) - 2)
        w = places[i + 1] - places[i]
        t = (a - places[i]) / w
        (b0, d0), (b1, d1) = fits[i], fits[i + 1]
        out.append((1 - t) ** 2 * (1 + 2 * t) * b0 + t**2 * (3 - 2 * t) * b1 + (t * (1 - t) ** 2 * d0 - t**2 * (1 - t) * d1) * w)
    return np.array(out)


def frame(spark, series):
    data = [(k, float(a), float(b)) for k, (x, y) in series.items() for a, b in zip(x, y)]
    return spark.createDataFrame(data, "region string, x double, y double").repartition(3)


@pytest.fixture(scope="module")
def series():
    rnd = np.random.default_rng(5)
    gaps = np.sort(rnd.choice(400, 150, replace=False)).astype(float)
    days = np.arange(60.0)
    return {"gaps": (gaps, np.sin(gaps / 40) + rnd.normal(0, 0.2, 150)), "days": (days, rnd.normal(0, 1, 60)), "short": (np.arange(26.0), rnd.normal(0, 1, 26))}


@pytest.mark.parametrize("span", [0.5, 0.2])
def test_matches_numpy(spark, series, span):
    got = loess_fit(frame(spark, series), "region", "x", "y", span).orderBy("region", "x").toPandas()
    for name, (x, y) in series.items():
        fit = got[got.region == name]["fit"].to_numpy()
        assert np.allclose(fit, blended(x, y, span, x), atol=1e-8)


def test_stays_close_to_the_direct_fit(spark, series):
    got = loess_fit(frame(spark, series), "region", "x", "y", 0.5).orderBy("region", "x").toPandas()
    x, y = series["gaps"]
    exact = np.array([direct(x, y, 0.5, a)[0] for a in x])
    off = np.abs(got[got.region == "gaps"]["fit"].to_numpy() - exact)
    assert np.mean(off) < 0.01 and np.max(off) < 0.06


def test_quadratics_are_reproduced_on_the_grid(spark):
    x = np.arange(40.0)
    got = loess_grid(frame(spark, {"a": (x, 3 - x + 0.5 * x * x)}), "region", "x", "y", 0.5).toPandas()
    assert len(got) == 80 and got.x.min() == 0 and got.x.max() == 39
    assert np.allclose(got.fit, 3 - got.x + 0.5 * got.x**2, atol=1e-7)


def test_short_series_and_missing_values(spark):
    data = [("tiny", dt.date(2020, 1, d), float(d)) for d in range(1, 4)]
    data += [("ok", dt.date(2020, 1, d), None if d == 7 else float(d)) for d in range(1, 31)]
    df = spark.createDataFrame(data, "region string, date date, y double")
    got = loess_fit(df, "region", "date", "y", 0.5)
    assert got.columns == ["region", "date", "y", "fit"] and got.count() == 33
    assert got.where((F.col("region") == "tiny") & F.col("fit").isNotNull()).count() == 0
    assert got.where("region = 'ok' and abs(fit - day(date)) > 1e-7").count() == 0


def test_work_is_linear_in_the_points(spark):
    """Rows sent to the vertex sums per point do not grow with the length of the series."""
    from daypanel.operators import loess

    per_point = []
    for n in (200, 3200):
        x = np.arange(float(n))
        pts = loess._points(frame(spark, {"a": (x, x)}), "region", "x", "y")
        v = loess._vertices(pts, "key", 0.2, loess.MIN_NEAR)
        sent = pts.join(v, "key").select(F.size(F.filter("vs", lambda p: F.abs(F.col("x") - p["at"]) < p["h"])).alias("m"))
        per_point.append(sent.agg(F.avg("m")).first()[0])
    assert max(per_point) < 14 and per_point[1] < per_point[0] * 1.5
