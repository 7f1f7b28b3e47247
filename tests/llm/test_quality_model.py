import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa

from daypanel.llm import quality_model as M
from daypanel.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    got = {r.doc_id: r for r in LLM_QUERIES["op8_quality_classifier"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    test = [(r.predicted, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert len(test) > 40 and np.mean([a == b for a, b in test]) > 0.95


def test_interactions_by_definition():
    rng = np.random.default_rng(1)
    column = pa.array(["a b c a\nd e | f", "", None, "x!! Y!! 12."])
    dense, bucket, value, at = M.features(column)
    size = dense.shape[1] + M.BUCKETS
    m = M.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, M.FACTORS)))
    got = m.parts(dense, bucket, value, at)[0]
    for i in range(4):
        x = {j: v for j, v in enumerate(dense[i])} | {dense.shape[1] + b: v for b, v in zip(bucket[at[i] : at[i + 1]], value[at[i] : at[i + 1]])}
        want = 0.3 + sum(m.weights[j] * v for j, v in x.items())
        want += sum(m.factors[a] @ m.factors[b] * x[a] * x[b] for a, b in combinations(x, 2))
        assert abs(got[i] - want) < 1e-8


def test_fit_separates():
    column = pa.array([f"{'good' if i % 2 else 'bad'} w{i % 7} w{i % 3}" for i in range(40)])
    label = np.array([i % 2 for i in range(40)], dtype=float)
    m = M.fit(*M.features(column), label)
    s = m.score(*M.features(column))
    assert s[label == 1].min() > s[label == 0].max()


def test_learns_only_from_the_other_folds(spark, frame):
    docs = frame([(i, f"word{i % 5} text {'###' if i % 2 else 'fine'}") for i in range(60)])
    label = lambda flip: spark.createDataFrame(
        [(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a = sorted((r.doc_id, r.score) for r in M.scores(docs, label(False)).collect())
    b = sorted((r.doc_id, r.score) for r in M.scores(docs, label(True)).collect())
    assert a == b


def test_edge_cases(spark, frame):
    docs = frame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "z " * 50000)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    got = M.scores(docs, labels).collect()
    assert len(got) == 5 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert all(abs(r.score - 0.5) < 1e-9 for r in M.scores(docs, labels.limit(0)).collect())
    assert M.scores(docs.limit(0), labels).collect() == []
