import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from daypanel.llm import decontaminate as D

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(ws, width):
    return [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]


def brute(docs, bench, threshold=0.8):
    """Every window of every item size, weighted Jaccard by definition."""
    words = [WORD.findall(t or "") for _, t in bench]
    sets = [set(shingles(w, min(5, len(w)))) if w else set() for w in words]
    seen = Counter(s for one in sets for s in one)
    weight = lambda s: math.log(1 + len(bench) / seen[s]) if s in seen else math.log(1 + len(bench))
    out = []
    for d, t in docs:
        ws = WORD.findall(t or "")
        for (item, _), own, one in zip(bench, words, sets):
            width = min(5, len(own))
            runs = shingles(ws, width) if own else []
            many, best = len(own) - width + 1, 0.0
            for a in range(max(1, len(runs) - many + 1)) if runs else []:
                w = set(runs[a : a + many])
                best = max(best, sum(map(weight, w & one)) / sum(map(weight, w | one)))
            if best >= threshold - 1e-9:
                out.append((str(d), -1 if item is None else item, round(best, 9)))
    return sorted(out)


@pytest.fixture
def data():
    rng = random.Random(8)
    words = lambda n: [rng.choice("the of and to in it was".split() + [f"w{i}" for i in range(300)]) for _ in range(n)]
    bench = [(i, " ".join(words(rng.randint(14, 55)))) for i in range(25)]
    bench += [(40, "one two three"), (41, ""), (42, None), (43, bench[3][1]), (None, "alpha beta gamma delta epsilon zeta")]
    docs = []
    for i in range(120):
        body = words(rng.choice([0, 5, 40, 200]))
        item = WORD.findall(bench[rng.randrange(25)][1])
        kind = i % 6
        if kind == 1:  # verbatim
            body[len(body) // 2 : len(body) // 2] = item
        elif kind == 2:  # one word changed
            item[rng.randrange(len(item))] = "changed"
            body[len(body) // 2 : len(body) // 2] = item
        elif kind == 3:  # part of an item only
            body[0:0] = item[: rng.randint(4, len(item))]
        elif kind == 4:  # two words changed at the ends
            item[0], item[-1] = "p", "q"
            body += item
        docs.append((i, " ".join(body)))
    return docs + [(500, None), (501, ""), (502, "x one two three y"), (500, "alpha beta gamma delta epsilon zeta"), (None, bench[0][1])], bench


def test_against_brute_force(spark, frame, data, monkeypatch):
    docs, bench = data
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = [(str(r.doc_id), r.item_id, round(r.similarity, 9)) for r in D.contaminated(frame(docs), table).collect()]
    assert sorted(got) == brute(docs, bench)


def test_parts_of_the_benchmark_give_the_same_documents(spark, frame, data, monkeypatch):
    docs, bench = data
    table = spark.createDataFrame(bench[:25], "item_id long, text string")
    whole = {(str(r.doc_id), r.item_id) for r in D.contaminated(frame(docs), table).collect() if r.similarity > 0.95}
    monkeypatch.setattr(D, "PART_WORDS", 150)
    assert whole <= {(str(r.doc_id), r.item_id) for r in D.contaminated(frame(docs), table).collect()}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    items = D.Items(list(range(60)), [" ".join(f"w{rng.integers(0, 99)}" for _ in range(20)) for _ in range(60)])
    prints = items.prints[rng.integers(0, 60, 400)].copy()
    for i in range(400):
        for b in rng.choice(64, rng.integers(0, 34), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    (size,) = items.sizes
    w, j = size.candidates(prints)
    far = np.bitwise_count(prints[:, None] ^ items.prints[None, :])
    assert set(zip(w.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= D.RADIUS))))


def test_clean_keeps_rows_and_columns(spark, frame, data):
    docs, bench = data
    table = spark.createDataFrame(bench, "item_id long, text string")
    bad = {d for d, _, _ in brute(docs, bench)}
    out = D.clean(frame(docs), table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(d) for d, t in docs if not (str(d) in bad and not (d == 500 and t is None)))
    assert D.contaminated(frame(docs), table.limit(0)).collect() == [] and D.contaminated(frame(docs).limit(0), table).collect() == []


@pytest.mark.parametrize("words", [60, 400])
def test_cut_into_parts_changes_no_similarity(spark, frame, monkeypatch, words):
    """Items that share a template, so that the weights of a part are not those of the benchmark."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    templates = [some(14) for _ in range(3)]
    bench = [(i, " ".join(templates[i % 3] + some(8) + templates[(i + 1) % 3][:9])) for i in range(24)]
    docs = []
    for i in range(60):
        own = WORD.findall(bench[i % 24][1])
        own[rng.choice([0, 15, 18, len(own) - 1])] = "changed"
        docs.append((i, " ".join(some(5) + own + templates[rng.randrange(3)])))
    table = spark.createDataFrame(bench, "item_id long, text string").repartition(3)
    want = brute(docs, bench)
    assert want
    monkeypatch.setattr(D, "PART_WORDS", words)
    got = [(str(r.doc_id), r.item_id, round(r.similarity, 9)) for r in D.contaminated(frame(docs), table).collect()]
    assert sorted(got) == want
    bad = {d for d, _, _ in want}
    assert sorted(str(r.doc_id) for r in D.clean(frame(docs), table).collect()) == sorted(str(d) for d, _ in docs if str(d) not in bad)


def test_one_scan_of_the_documents(spark, frame, data, monkeypatch):
    """However the benchmark is cut, the documents are read once, and no text of the benchmark comes to the driver."""
    docs, bench = data
    scans = []
    plain = D.A.map_texts

    def counted(df, column, fn, schema):
        scans.append(df.columns)
        return plain(df, column, fn, schema)

    monkeypatch.setattr(D.A, "map_texts", counted)
    monkeypatch.setattr(D, "PART_WORDS", 20)
    D.contaminated(frame(docs), spark.createDataFrame(bench, "item_id long, text string"))
    assert scans.count(["doc_id", "text"]) == 1 and len(scans) == 2


def test_recall_and_selectivity_of_the_radius():
    """Windows at the threshold lie within the radius; unrelated ones hardly ever."""
    rng = np.random.default_rng(12)
    near = total = far = 0
    for n in (15, 30, 60, 120):
        texts = [" ".join(f"w{rng.integers(0, 3000)}" for _ in range(n)) for _ in range(60)]
        items = D.Items(list(range(60)), texts)
        for i, t in enumerate(texts):
            ws = t.split()
            while True:  # change words one by one until the next change would fall below the threshold
                other = list(ws)
                other[rng.integers(0, n)] = f"x{rng.integers(0, 10**9)}"
                buf, offs = D.A.utf8(D.pa.array([" ".join(other)]))
                runs = D._runs(D.A.span_hash(buf, *D.A.words(buf, offs)[:2]), 5)
                if items.similarity(runs, i) < 0.8:
                    break
                ws = other
            buf, offs = D.A.utf8(D.pa.array([" ".join(ws)]))
            own = items.fingerprint(D._runs(D.A.span_hash(buf, *D.A.words(buf, offs)[:2]), 5))
            near += int(np.bitwise_count(own ^ items.prints[i])) <= D.RADIUS
            total += 1
        apart = np.bitwise_count(items.prints[:, None] ^ items.prints[None, :])[~np.eye(60, dtype=bool)]
        far += (apart <= D.RADIUS).mean() / 4
    assert near >= 0.99 * total and far < 0.05


def test_template_benchmark_and_many_items(spark, frame):
    """Items that share nearly all shingles, and a document that holds them all."""
    rng = random.Random(5)
    some = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    template = some(30)
    bench = [(i, " ".join(template[:20] + [f"q{i}"] + template[20:])) for i in range(30)] + [(99, " ".join(some(20)))]
    docs = [(0, " ".join(t for _, t in bench)), (1, " ".join(template)), (2, " ".join(some(100))), (3, bench[4][1])]
    got = [(str(r.doc_id), r.item_id, round(r.similarity, 9)) for r in D.contaminated(frame(docs), spark.createDataFrame(bench, "item_id long, text string")).collect()]
    assert sorted(got) == brute(docs, bench)
