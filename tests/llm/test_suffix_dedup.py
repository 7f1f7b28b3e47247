import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daypanel.llm import suffix_dedup as S
from daypanel.llm.lyndon_suffixes import suffix_arrays


def brute(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, gone = {}, {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p : p + length], (rows[i][0], p))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        cut = np.zeros(len(raw) + 1, dtype=bool)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] != (d, p):
                cut[p : p + length] = True
        cut = cut[:-1]
        kept = bytes(b for b, c in zip(raw, cut) if not c)
        spans = int(np.sum(np.diff(np.concatenate([[0], cut.astype(int)])) == 1))
        out.append((str(d), len(raw), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passages = [text(rng.choice([15, 25, 60])) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [text(rng.choice([3, 10, 40]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 30) :], text(rng.choice([1, 4]))]
        rows.append((i * 3, " ".join(parts)))
    copy = rows[5][1]
    rows += [(200 + i, copy) for i in range(4)] + [(300 + i, copy[:200] + f"#{i}" + copy[200:]) for i in range(12)]
    rows += [(400, "a" * 777), (401, "ab" * 300), (402, "line of text\n" * 90), (403, "x" * 99), (404, "x" * 100)]
    rows += [(500, None), (501, ""), (None, copy), (210, copy), (210, copy)]
    rng.shuffle(rows)
    return rows


def result(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("most", [256, 3])
def test_against_brute_force(spark, frame, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "BATCH", 4000)
    rows = corpus()
    assert result(S.removed(frame(rows))) == brute(rows)


def test_cut_leaves_whole_characters_and_columns(spark, frame):
    shared = "é" * 120
    docs = frame([(1, "aa " + shared + " bb"), (2, "cc " + shared + " dd"), (3, shared), (4, "short"), (5, None)])
    out = S.cut(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1].startswith("aa ") and got[2].startswith("cc") and got[2].endswith("dd") and len(got[2]) < 20
    assert got[4] == "short" and got[5] is None and 3 not in got
    assert S.cut(docs.limit(0)).collect() == [] and S.removed(docs.limit(0)).collect() == []


def test_suffix_arrays_against_sorting():
    rng = np.random.default_rng(4)
    for _ in range(80):
        lengths = rng.integers(0, 50, rng.integers(1, 7))
        texts = [rng.integers(0, rng.integers(1, 5), n) for n in lengths]
        offs = np.concatenate([[0], np.cumsum(lengths)])
        got = suffix_arrays(np.concatenate(texts), offs)
        for i, t in enumerate(texts):
            assert list(got[offs[i] : offs[i + 1]] - offs[i]) == sorted(range(len(t)), key=lambda p: list(t[p:]))


def test_null_ids_are_documents_of_their_own(spark, frame):
    """Texts without id are documents in the order of a hash; fully equal rows are one document."""
    rng = random.Random(9)
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(130))
    passage = own()
    texts = [own() + passage + own() for _ in range(30)]
    keyed = spark.createDataFrame([(None, t) for t in texts], "doc_id bigint, text string")
    place = {r.text: r.k for r in keyed.select("text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    order = sorted(texts, key=place.get)
    for rows in (texts, texts + texts[:1], texts + order[:1] * 3 + order[7:9] * 2):
        want = brute([(i, t) for i, t in enumerate(order)] + [(order.index(t), t) for t in rows[len(texts) :]])
        got = result(S.removed(frame([(None, t) for t in rows])))
        assert [g[1:] for g in sorted(got, key=lambda g: g[4])] == [w[1:] for w in sorted(want, key=lambda w: w[4])]


@pytest.mark.parametrize("n", [2000])
def test_null_ids_cost_as_much_as_others(spark, frame, n):
    import time

    rng = random.Random(10)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(n // 4)]
    texts = [" ".join(rng.choice(passages) + str(rng.random()) for _ in range(3)) for _ in range(n)]
    times = []
    for ids in (range(n), [None] * n):
        began = time.perf_counter()
        S.removed(frame(list(zip(ids, texts)))).collect()
        times.append(time.perf_counter() - began)
    assert times[1] < 2 * times[0] + 5
