"""Filled days and offsets in days against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daypanel.operators import gaps

START = dt.date(2020, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    out = {}
    for region, span, share in (("A", 60, 0.5), ("B", 30, 0.1), (None, 20, 0.7), ("one", 1, 1.0)):
        for n in range(span):
            if rng.random() < share or n == 0:
                out[region, n + (7 if region == "B" else 0)] = rng.choice([None, float(rng.randrange(50))])
    return out


@pytest.fixture(scope="module")
def panel(spark, data):
    rows = [(r, day(n), v, v, v, v, n) for (r, n), v in data.items()] + [("A", None, 1.0, 1.0, 1.0, 1.0, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "region string, date date, c double, z double, n double, l double, i int").repartition(3)


def brute(data, lo=None, hi=None):
    out = []
    for region in {r for r, _ in data}:
        known = sorted(n for r, n in data if r == region)
        first, last = min(known[0], known[0] if lo is None else lo), max(known[-1], known[-1] if hi is None else hi)
        for n in range(first, last + 1):
            if n in known:
                v = data[region, n]
                out.append((region, day(n), v, v, v, v, False))
                continue
            back, on = max((k for k in known if k < n), default=None), min((k for k in known if k > n), default=None)
            if back is None:
                out.append((region, day(n), 0.0, 0.0, None, None, True))
                continue
            a, b = data[region, back], None if on is None else data[region, on]
            line = None if a is None or b is None else a + (b - a) * ((n - back) / (on - back))
            out.append((region, day(n), a, 0.0, None, line, True))
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


RULES = {"c": "carry", "z": "zero", "n": "null", "l": "linear"}


def test_days_between_are_filled(panel, data, rows):
    assert rows(gaps.fill_days(panel, RULES, filled="made")) == brute(data)


def test_common_range_of_all_regions(panel, data, rows):
    ends = panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    got = gaps.fill_days(panel, RULES, first=ends.select("lo").scalar(), last=ends.select("hi").scalar(), filled="made")
    known = [n for _, n in data]
    assert rows(got) == brute(data, min(known), max(known))


def test_unknown_rules_and_empty_panels(panel):
    with pytest.raises(ValueError):
        gaps.fill_days(panel, {"c": "guess"})
    assert gaps.fill_days(panel.limit(0), RULES).collect() == []


def test_offsets_count_days(panel, data, rows):
    w = gaps.days()
    got = panel.where("date IS NOT NULL").select(
        "region", "i", gaps.shift_days("c", 3, w).alias("a"), gaps.change_days("c", 7, w).alias("b"), gaps.last_known("c", 2, w).alias("d")
    )
    want = []
    for (r, n), v in data.items():
        then = data.get((r, n - 7))
        older = [data[x] for x in sorted((k for k in data if k[0] == r and k[1] <= n - 2), key=lambda k: k[1]) if data[x] is not None]
        want.append((r, n, data.get((r, n - 3)), None if v is None or then is None else v - then, older[-1] if older else None))
    assert rows(got) == sorted(want, key=lambda r: [(v is not None, str(v)) for v in r])
