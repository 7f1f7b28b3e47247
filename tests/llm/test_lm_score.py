import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from daypanel.llm import arrays as A
from daypanel.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, good, classes):
    """Both models by dictionaries."""
    tokens = [WORD.findall(t or "") for _, t in docs]
    hashes = {w: int(L._tokens(pa.array([w]))[0][0]) for ws in tokens for w in ws}
    count = Counter(w for ws in tokens for w in ws)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    top = sorted(count, key=lambda w: (-count[w], signed(hashes[w])))[:classes]
    place = {w: i for i, w in enumerate(sorted(top, key=lambda w: hashes[w]))}
    symbol = lambda w: place[w] + 1 if w in place else classes + 1 + int(A.mix(np.array([hashes[w]], np.uint64))[0] % np.uint64(classes))
    pairs = [[(0 if i == 0 else symbol(ws[i - 1]), symbol(w)) for i, w in enumerate(ws)] for ws in tokens]
    counts = [Counter(p for (d, _), ps in zip(docs, pairs) if all_ or d in good for p in ps) for all_ in (False, True)]
    total, size = sum(counts[0].values()), 2 * classes
    out = []
    for (d, _), ps in zip(docs, pairs):
        loss = []
        for c in counts:
            scale = total / sum(c.values())
            one, after = Counter(), Counter()
            for (a, b), n in c.items():
                one[b] += n * scale
                after[a] += n * scale
            p = lambda a, b: (c[a, b] * scale + L.PRIOR * ((1 - L.UNIFORM) * one[b] / total + L.UNIFORM / size)) / (after[a] + L.PRIOR)
            loss.append(-sum(math.log(p(a, b)) for a, b in ps) / max(1, len(ps)))
        out.append((str(d), len(ps), loss[0], loss[1], loss[1] - loss[0]))
    return sorted(out)


def test_against_brute_force(spark, frame):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("abcdefghijklmnop" if i % 3 else "mnopqrst") * rng.choice([1, 1, 2]) for _ in range(rng.choice([0, 3, 40])))) for i in range(50)]
    docs += [(60, None), (61, " \n"), (None, "a b c"), (1, docs[1][1]), (62, "x " * 3000)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)] + [(0, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = sorted(tuple([str(r.doc_id), *r[1:]]) for r in L.scores(frame(docs), labels, classes=9).collect())
    want = brute(docs, {i for i in range(50) if i % 3 == 0}, 9)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=2e-5)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, (11, 11)).astype(float)
    counts[:, 0] = 0
    counts[4] = 0
    p = np.exp(L.log_probabilities(counts, 77.0))
    assert np.allclose(p[:, 1:].sum(axis=1), 1, atol=1e-3)


def test_target_like_texts_score_higher(spark):
    import daypanel.llm.queries as Q

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.score for r in Q.LLM_QUERIES["op9_lm_scoring"](spark, sf).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = np.array([got[d] for d, y in label.items() if y == 1])
    bad = np.array([got[d] for d, y in label.items() if y == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_edge_cases(spark, frame):
    docs = frame([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in L.scores(docs, none).collect()] == [0.0, 0.0]
    assert L.scores(docs.limit(0), none).collect() == []


def brute_whole(docs, good):
    """Both models by dictionaries over the words themselves."""
    tokens = [["", *WORD.findall(t or "")] for _, t in docs]
    counts = [Counter(p for (d, _), ws in zip(docs, tokens) if all_ or d in good for p in zip(ws, ws[1:])) for all_ in (False, True)]
    total, size = sum(counts[0].values()), len({w for ws in tokens for w in ws[1:]})
    out = []
    models = []
    for c in counts:
        one, after = Counter(), Counter()
        for (a, b), n in c.items():
            one[b] += n * total / sum(c.values())
            after[a] += n * total / sum(c.values())
        models.append((c, total / sum(c.values()), one, after))
    for (d, _), ws in zip(docs, tokens):
        loss = []
        for c, scale, one, after in models:
            p = lambda a, b: (c[a, b] * scale + L.PRIOR * ((1 - L.UNIFORM) * one[b] / total + L.UNIFORM / size)) / (after[a] + L.PRIOR)
            loss.append(-sum(math.log(p(a, b)) for a, b in zip(ws, ws[1:])) / max(1, len(ws) - 1))
        out.append((str(d), len(ws) - 1, loss[0], loss[1], loss[1] - loss[0]))
    return sorted(out)


def test_every_word_counts_for_itself(spark, frame):
    """Thousands of words, nulls and repeated rows."""
    rng = random.Random(11)
    word = lambda: f"w{int(rng.paretovariate(0.15)) % 5000}"
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 60, 300])))) for i in range(80)]
    docs += [(90, None), (91, " \n"), (None, "w1 w2 w2999"), (1, docs[1][1]), (92, "w7 " * 900), (None, docs[5][1])]
    assert len({w for _, t in docs for w in WORD.findall(t or "")}) > 1024
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int")
    got = sorted(tuple([str(r.doc_id), *r[1:]]) for r in L.scores(frame(docs), labels).collect())
    want = brute_whole(docs, {i for i in range(80) if i % 4 == 0})
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-8)


def brute_without_own(docs, good):
    """Each text by the counts of all other rows."""
    tokens = [["", *WORD.findall(t or "")] for _, t in docs]
    size, out = len({w for ws in tokens for w in ws[1:]}), []
    for i, (d, _) in enumerate(docs):
        counts = [Counter(p for j, ((e, _), ws) in enumerate(zip(docs, tokens)) if j != i and (every or e in good) for p in zip(ws, ws[1:])) for every in (False, True)]
        total, loss = max(1, sum(counts[0].values())), []
        for c in counts:
            scale = total / max(1, sum(c.values()))
            one, after = Counter(), Counter()
            for (a, b), n in c.items():
                one[b] += n * scale
                after[a] += n * scale
            p = lambda a, b: (c[a, b] * scale + L.PRIOR * ((1 - L.UNIFORM) * one[b] / total + L.UNIFORM / size)) / (after[a] + L.PRIOR)
            loss.append(-sum(math.log(p(a, b)) for a, b in zip(tokens[i], tokens[i][1:])) / max(1, len(tokens[i]) - 1))
        out.append((str(d), len(tokens[i]) - 1, loss[0], loss[1], loss[1] - loss[0]))
    return sorted(out)


def test_texts_are_scored_without_their_own_counts(spark, frame):
    rng = random.Random(13)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.choice([0, 1, 2, 30, 90])))) for i in range(40)]
    docs += [(50, None), (51, "w1 w1 w1 w1"), (1, docs[1][1]), (None, docs[5][1]), (52, docs[8][1])]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int")
    got = sorted((str(r.doc_id), r.n_tokens, *r[5:]) for r in L.scores(frame(docs), labels, leave_out=True).collect())
    want = brute_without_own(docs, {i for i in range(40) if i % 4 == 0})
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2:] for g in got], [w[2:] for w in want], atol=1e-8)


def test_texts_that_occur_twice_are_told_apart(spark, frame):
    rng = random.Random(14)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    docs = [(i, text()) for i in range(200)]
    docs += [(1000 + i, docs[i][1]) for i in range(0, 200, 10)]
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.left_out_background_loss for r in L.scores(frame(docs), labels, leave_out=True).collect()}
    twice = [got[i] for i in range(0, 200, 10)]
    assert max(twice) < min(got[i] for i in range(200) if i % 10)


def test_what_moves_does_not_grow_with_the_buckets(spark):
    """Bytes packed for 128 and for 8,192 buckets of the same corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(True).alias("good"))
    table = L.chunks(docs)
    size = lambda n: L.entries(table, n).agg(F.sum(sum((F.octet_length(c) for c in ("keys", "good", "every")), F.lit(0)))).first()[0]
    few, many = size(128), size(8192)
    assert many < 1.5 * few
    assert few < 5_000_000


def test_chunks_and_buckets_do_not_matter(spark, frame, monkeypatch):
    rng = random.Random(15)
    docs = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(80)))) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    results = []
    for parts, bucket in ((1, 500_000), (17, 10)):
        monkeypatch.setattr(L, "BUCKET", bucket)
        results.append(sorted(tuple(r) for r in L.scores(frame(docs, parts), labels, leave_out=True).collect()))
    assert [r[:2] for r in results[0]] == [r[:2] for r in results[1]]
    assert np.allclose([r[2:] for r in results[0]], [r[2:] for r in results[1]], atol=1e-8)
