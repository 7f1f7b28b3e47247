import random
import re
from collections import Counter

import pytest

import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_ngram_join import grams
from tests.llm.test_quality_rules import brute as brute_base
from tests.llm.test_suffix_dedup import brute as brute_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(6)
    words = lambda n: [rng.choice([f"wörd{i}" for i in range(900)]) for _ in range(n)]
    bench = [(i, " ".join(words(rng.randint(20, 50)))) for i in range(8)]
    passage = " ".join(words(60))
    rows = []
    for i in range(90):
        body = words(rng.choice([3, 40, 120]))
        if i % 9 == 1:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        if i % 11 == 2:
            body += bench[i % 8][1].split()
        if i % 13 == 3:
            body = ["junk###"] * len(body)
        rows.append((i, " ".join(body)))
    rows += [(100 + i, rows[i][1]) for i in (0, 4, 5)] + [(110, rows[4][1] + " tail"), (120, None), (121, ""), (None, " ".join(words(30)))]
    folder = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), bench


def test_stages_against_brute_force(spark, corpus):
    sf, bench = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            break
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(after)
        if name == "quality_rules":
            for d, t in before.items():
                n, _, symbols, _, repeats = brute_base(t)
                if n < 10 or 100 * repeats > 20 * n or 10 * symbols > n:
                    assert d not in after
                elif "junk" not in t:
                    assert after[d] == t
        if name == "ngram_join":
            sets = {d: grams(t) for d, t in before.items()}
            similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
            for d in before:
                lower = [e for e in before if None not in (d, e) and e < d and similar(d, e)]
                assert (d in after) == (not lower)
        if name == "suffix_dedup":
            want = {d: n for d, _, n, _, _ in brute_spans(list(before.items()))}
            for d, t in before.items():
                left = len(after[d].encode()) if d in after else 0
                assert abs(len(t.encode()) - want[str(d)] - left) <= 8 and (d in after or left == 0)
                assert want[str(d)] or after[d] == t
        if name == "decontamination":
            bad = {d for d, _, _ in brute_leaks(list(before.items()), bench)}
            assert set(map(str, after)) == {str(d) for d in before} - bad and len(bad) > 2
        before, docs = after, spark.createDataFrame(out.collect(), out.schema)
    sums = Counter()
    for r in out.collect():
        sums[r.doc_id] += r.length
    assert set(sums) == set(before)


def test_run_applies_the_stages(spark, corpus):
    sf, _ = corpus
    out = C.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < 80
