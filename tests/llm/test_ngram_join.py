import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.llm import ngram_join as J
from daypanel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    ws = WORD.findall(text or "")
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
    classes = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            classes[root[i]] = min(d, classes.get(root[i], d))
    return sorted((str(d), str(classes.get(root[i])), len(links[i])) for i, (d, _) in enumerate(rows))


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "ß!"]
    rows = []
    for base in range(12):
        ws = [rng.choice(vocab) for _ in range(rng.choice([3, 30, 90, 400]))]
        for copy in range(rng.choice([1, 2, 9])):
            own = list(ws)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append((len(rows) + 1, (" " if copy % 2 else "\n").join(own)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "a b"), (904, "a  b"), (3, rows[2][1]), (None, rows[4][1]), (None, None)]


@pytest.mark.parametrize("block", [768, 3])
def test_classes_and_links_against_brute_force(spark, frame, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = corpus()
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in J.near_duplicates(frame(rows)).collect())
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark, frame, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 20)
    rng = random.Random(1)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = J.near_duplicates(frame(rows)).collect()
    assert {r.class_id for r in got} == {0}
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(rows)


def test_bands_reach_the_recall():
    bands, rows = J.choose_bands(0.8, 0.999)
    assert bands <= 16 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_keep_one_of_each_group(spark, frame):
    text = " ".join(f"w{i}" for i in range(50))
    docs = frame([(5, text), (2, text), (2, text), (9, "other words of a text"), (None, text), (7, None)])
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    # The row without id is a copy of a kept row.
    assert sorted(str(r.doc_id) for r in out.collect()) == ["2", "7", "9"]
    assert J.keep_one(docs.limit(0)).collect() == []


def test_keep_one_judges_rows(spark, frame):
    words = lambda a, n=40: " ".join(f"{a}{i}" for i in range(n))
    rows = [
        (1, words("a")), (1, words("b")), (1, words("c") + " more"), (0, words("c")),  # one id, three texts, one of them a near copy of an earlier row
        (None, words("d")), (None, words("d")), (None, words("d") + " end"), (None, words("e")),  # no ids: one of the near copies stays
        (5, words("e")), (6, ""), (6, None), (6, " "),
    ]
    docs = frame(rows)
    for name in ("_id", "_class", "id", "tk", "again", "root", "a.b", "node"):
        docs = docs.withColumn(name, F.lit(name))
    out = J.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    alone = [g for g in got if g[0] is None]
    assert len(alone) == 1 and alone[0][1].startswith("d0")
    assert [g for g in got if g[0] is not None] == sorted([(0, words("c")), (1, words("a")), (1, words("b")), (5, words("e")), (6, ""), (6, None), (6, " ")], key=str)
    assert {r["a.b"] for r in out.collect()} == {"a.b"}


def test_null_ids_cost_as_much_as_others(spark, frame):
    import time

    rng = random.Random(4)
    rows = []
    for i in range(1000):
        base = [f"w{rng.randrange(3000)}" for _ in range(80)]
        rows += [" ".join(base), " ".join([*base, f"x{i}"])]
    times, found = [], []
    for ids in (range(len(rows)), [None] * len(rows)):
        began = time.perf_counter()
        found.append(sorted(r.n_links for r in J.near_duplicates(frame(list(zip(ids, rows)))).collect()))
        times.append(time.perf_counter() - began)
    assert found[0] == found[1] and set(found[0]) == {1}
    assert times[1] < 2 * times[0] + 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 201), (201, 202), (200, 202)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}


def test_differences_give_the_intersection():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    parts = [J._difference(s.tobytes(), sets[0].tobytes()) for s in sets]
    got = J.linked(len(sets[0]), [np.frombuffer(p[0], np.int32) for p in parts], [np.frombuffer(p[1], np.uint64) for p in parts], 0.5)
    for i in range(9):
        for j in range(9):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (i != j and len(a & b) / len(a | b) >= 0.5)
