"""Local regression (loess, degree two, tricube weights) for many series at once.

The fit is made at a few vertices per series and blended in between, as the published method does by
default: the sorted points are halved by position until a cell has at most ``n * span * cell`` of them,
a weighted quadratic is fitted at every cell border from the ``n * span`` nearest points, and cubic
Hermite pieces join the fitted values and slopes. The number of vertices depends on the span only, not
on the length of the series, so the work is linear in the points and no pairs of points are formed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from daypanel.operators.blocks import placed
from daypanel.operators.reshape import q
from daypanel.session import stage

CELL = 0.2  # share of a neighbourhood above which a cell is cut
MIN_NEAR = 4  # points in a neighbourhood that determine a weighted quadratic
SENT_SERIES = 20_000  # series whose vertices, under a kilobyte each, every task may hold
MARGIN = 0.005  # the outer vertices lie this share of the range outside the data


def _cells(n: Column, limit: Column, span: float) -> Column:
    """Position ranges of the leaf cells of 1..n, by repeated halving down to ``limit`` points."""
    depth = math.ceil(math.log2(2 / (span * CELL))) + 1

    def halve(cells: Column, _: Column) -> Column:
        def parts(c: Column) -> Column:
            mid = F.floor((c["lo"] + c["hi"]) / 2).cast("int")
            left = F.struct(c["lo"].alias("lo"), mid.alias("hi"))
            right = F.struct((mid + 1).alias("lo"), c["hi"].alias("hi"))
            return F.when(c["hi"] - c["lo"] + 1 > limit, F.array(left, right)).otherwise(F.array(c))

        return F.flatten(F.transform(cells, parts))

    whole = F.array(F.struct(F.lit(1).alias("lo"), n.alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), whole, halve)


def _vertices(points: DataFrame, key: str, span: float, least: int) -> DataFrame:
    """One row per series: vertex positions with the distance to their ``n * span``-th nearest point.

    The sorted positions of one series are held as an array; a series is bounded by the calendar.
    """
    xs = F.col("xs")
    first, last = F.element_at(xs, 1), F.element_at(xs, -1)
    pad = MARGIN * F.greatest(last - first, F.greatest(F.abs(first), F.abs(last)) * 1e-3 + 1e-30)
    cuts = F.transform(
        F.filter("cells", lambda c: c["hi"] < F.col("n")),
        lambda c: (F.element_at(xs, c["hi"]) + F.element_at(xs, c["hi"] + 1)) / 2,
    )

    def reach(v: Column) -> Column:
        """Distance to the q-th nearest point: the best of the windows of q neighbouring points."""
        starts = F.sequence(F.lit(1), F.col("n") - F.col("near") + 1)
        worst = F.transform(
            starts, lambda i: F.greatest(v - F.element_at(xs, i), F.element_at(xs, i + F.col("near") - 1) - v)
        )
        return F.array_min(worst)

    series = points.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("n", F.size("xs"))
    sized = series.withColumns(
        {
            "near": F.least(F.col("n"), F.floor(F.col("n") * span + 1e-5).cast("int")),
            "limit": F.greatest(F.lit(1), F.floor(F.col("n") * span * CELL).cast("int")),
        }
    ).where(F.col("near") >= least)
    placed = sized.withColumn("cells", _cells(F.col("n"), F.col("limit"), span)).withColumn(
        "at", F.concat(F.array(first - pad), cuts, F.array(last + pad))
    )
    return placed.select(
        "key", F.transform("at", lambda v, i: F.struct(i.alias("v"), v.alias("at"), reach(v).alias("h"))).alias("vs")
    )


def _vertices_spread(points: DataFrame, key: str, span: float, least: int) -> DataFrame:
    """The same vertices and distances for series of any length, from the places of the points instead of an array.

    A cell border is the middle of two points whose places follow from the number of points alone. The q-th nearest point of
    a vertex ends the best window of q neighbouring points; a window is the join of a place with the place q - 1 further on,
    and only those that hold the vertex can be the best (or the first and the last, for the outer vertices).
    """
    rows = placed(points.select("key", "x"), ["key"], ["x"])
    series = rows.groupBy("key").agg(F.max("_n").cast("int").alias("n"), F.min("x").alias("first"), F.max("x").alias("last"))
    sized = series.withColumns(
        {
            "near": F.least(F.col("n"), F.floor(F.col("n") * span + 1e-5).cast("int")),
            "limit": F.greatest(F.lit(1), F.floor(F.col("n") * span * CELL).cast("int")),
        }
    ).where(F.col("near") >= least)
    first, last = F.col("first"), F.col("last")
    pad = MARGIN * F.greatest(last - first, F.greatest(F.abs(first), F.abs(last)) * 1e-3 + 1e-30)
    # One row per series, with as many borders as the span asks for.
    sized = sized.withColumn("cells", _cells(F.col("n"), F.col("limit"), span)).withColumn("pad", pad)
    borders = sized.select("key", F.explode(F.filter("cells", lambda c: c["hi"] < F.col("n"))).alias("c")).select(
        "key", F.col("c.hi").alias("v"), F.explode(F.array(*[(F.col("c.hi") - i).cast("bigint") for i in (1, 0)])).alias("_pos")
    )
    cuts = rows.join(borders, ["key", "_pos"]).groupBy("key", "v").agg(((F.min("x") + F.max("x")) / 2).alias("at"))
    inner = cuts.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "at"))), lambda c: c["at"]).alias("cuts"))
    outer = _stage_small(sized.join(inner, "key", "left").select(
        "key", "n", "near", F.concat(F.array(first - F.col("pad")), F.coalesce("cuts", F.array().cast("array<double>")), F.array(last + F.col("pad"))).alias("ats")
    ))
    shift = outer.select("key", F.col("near").cast("bigint").alias("near"))
    ends = rows.join(shift, "key").select("key", (F.col("_pos") - F.col("near") + 1).alias("_pos"), F.col("x").alias("hi")).where("_pos >= 0")
    windows = rows.select("key", "_pos", F.col("x").alias("lo")).join(ends, ["key", "_pos"]).join(outer, "key")
    lo, hi, at = F.col("lo"), F.col("hi"), F.col("_pos")
    held = F.filter("ats", lambda v: ((v >= lo) & (v <= hi)) | ((at == 0) & (v <= lo)) | ((at == F.col("n") - F.col("near")) & (v >= hi)))
    reach = windows.select("key", "lo", "hi", F.explode(held).alias("at")).groupBy("key", "at").agg(
        F.min(F.greatest(F.col("at") - F.col("lo"), F.col("hi") - F.col("at"))).alias("h")
    )
    found = reach.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("vs"))
    return _stage_small(found.select("key", F.transform("vs", lambda v, i: F.struct(i.alias("v"), v["at"].alias("at"), v["h"].alias("h"))).alias("vs")))


def _stage_small(df: DataFrame) -> DataFrame:
    """A table of one row per series, written once; sent to every task if its count says that it is small, else joined by key."""
    df = stage(df, "per-series")
    return F.broadcast(df) if df.count() <= SENT_SERIES else df


def _vertex_fits(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """Value and slope of the weighted quadratic at every vertex, from eight sums per vertex.

    A point is sent only to the vertices whose neighbourhood holds it (about ten), and the sums combine
    map-side; everything is partitioned by series, so there is no shuffle beyond the one by key.
    """
    near = (
        points.join(vertices, "key")
        .select(
            "key",
            "x",
            "y",
            F.inline(F.filter("vs", lambda v: F.abs(F.col("x") - v["at"]) < v["h"])),
        )
        .withColumn("u", (F.col("x") - F.col("at")) / F.col("h"))
        .withColumn("w", F.pow(1 - F.pow(F.abs("u"), 3), 3))
    )
    u, w, y = F.col("u"), F.col("w"), F.col("y")
    power = [F.lit(1.0), u, u * u, u * u * u, u * u * u * u]
    sums = near.groupBy("key", "v", "at", "h").agg(
        F.count(F.lit(1)).alias("m"),
        *[F.sum(w * p).alias(f"s{i}") for i, p in enumerate(power)],
        *[F.sum(w * p * y).alias(f"t{i}") for i, p in enumerate(power[:3])],
    )
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    c00, c01, c02 = s2 * s4 - s3 * s3, s2 * s3 - s1 * s4, s1 * s3 - s2 * s2
    c11, c12 = s0 * s4 - s2 * s2, s1 * s2 - s0 * s3
    det = s0 * c00 + s1 * c01 + s2 * c02
    solvable = F.col("m") >= 3
    return sums.select(
        "key",
        "v",
        "at",
        F.when(solvable, F.try_divide(c00 * t0 + c01 * t1 + c02 * t2, det)).alias("b"),
        F.when(solvable, F.try_divide(c01 * t0 + c11 * t1 + c12 * t2, det) / F.col("h")).alias("d"),
    )


def _blend(x: Column, lo: Column, hi: Column) -> Column:
    """Cubic Hermite piece between two vertices."""
    width = hi["at"] - lo["at"]
    t = (x - lo["at"]) / width
    r = 1 - t
    return (
        r * r * (1 + 2 * t) * lo["b"]
        + t * t * (3 - 2 * t) * hi["b"]
        + (t * r * r * lo["d"] - t * t * r * hi["d"]) * width
    )


def _evaluate(rows: DataFrame, fits: DataFrame, out: str) -> DataFrame:
    """Fitted value for rows with (key, x); the vertices of a series are a short sorted array."""
    curve = fits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "b", "d"))).alias("_curve"))
    below = F.size(F.filter("_curve", lambda v: v["at"] <= F.col("x")))
    i = F.greatest(F.lit(1), F.least(below, F.size("_curve") - 1))
    fitted = _blend(F.col("x"), F.element_at("_curve", i), F.element_at("_curve", i + 1))
    return rows.join(curve, "key", "left").withColumn(out, fitted).drop("_curve")


def _points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    at = F.unix_date(q(x)) if dict(df.dtypes)[x] == "date" else q(x)
    return df.select(q(key).alias("key"), at.cast("double").alias("x"), q(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )


def loess_fit(
    df: DataFrame, key: str, x: str, y: str, span: float, out: str = "fit", least: int = MIN_NEAR, spread: bool = False
) -> DataFrame:
    """Add the smoothed value to every row; ``x`` is a date or a number, one row per (key, x).

    Rows without ``y`` take no part in the fit but get a value inside the fitted range of their series.
    Series with fewer than ``least`` points in a neighbourhood (a quadratic with weights needs four) have no fit, nor has the surrounding of a vertex
    at which fewer than three points carry weight. The points of a series are held in an array, which the calendar
    bounds; ``spread=True`` is for series of any length.
    """
    points = _points(df, key, x, y)
    find = _vertices_spread if spread else _vertices
    fits = _vertex_fits(points, find(points, key, span, least))
    at = F.unix_date(q(x)) if dict(df.dtypes)[x] == "date" else q(x)
    rows = df.withColumns({"key": q(key), "x": at.cast("double")}) if key != "key" else df.withColumn("x", at.cast("double"))
    done = _evaluate(rows, fits, out)
    return done.drop(*[c for c in ("key", "x") if c not in df.columns]).select(*[q(c) for c in df.columns], q(out))


def loess_grid(
    df: DataFrame, key: str, x: str, y: str, span: float, points: int = 80, least: int = MIN_NEAR, spread: bool = False
) -> DataFrame:
    """The smoothed curve on evenly spaced positions over the range of each series, as it would be drawn."""
    pts = _points(df, key, x, y)
    find = _vertices_spread if spread else _vertices
    fits = _vertex_fits(pts, find(pts, key, span, least))
    ends = pts.groupBy("key").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = ends.select(
        "key", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") + step * i)).alias("x")
    )
    return _evaluate(grid, fits, "fit").select(F.col("key").alias(key), "x", "fit")
