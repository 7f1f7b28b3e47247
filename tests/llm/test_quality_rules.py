import re
from collections import Counter

from pyspark.sql import functions as F

from daypanel.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = [
    None, "", " \n\t ", "one two three", "a b c d e f g h i j k", "w " * 50,
    "the quick brown fox jumps over the lazy dog again and again\n" * 3,
    "Éa ñb öc dd ee ff gg hh ii jj kk", "x# y* z$ a% b& c| d< e> f g h i j k", "NO!! YES!! " * 8 + "end",
    "a b c d e f g h i j k l m", "\n\n\nq r s t u v w x y z aa bb\n \nq r", "z" * 900 + " b c d e f g h i j k",
    " ".join(f"w{i}" for i in range(30000)), "k l m n o p q r s t\r\nk l m n o\r\n",
]


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cover = {j for i in range(len(ws) - 4) if grams[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    ls = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in Q.SYMBOLS for c in t), len(ls) - len(set(ls)), len(cover)


def test_base_figures(spark, frame):
    got = {r.doc_id: tuple(r)[1:] for r in Q.judge(frame(enumerate(TEXTS))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = brute(t)
        assert got[i][:5] == want
        assert got[i][5] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[i][5] and got[i][6])


def test_order_does_not_change_the_verdict(spark, frame):
    docs = frame(enumerate(TEXTS * 2))
    a = sorted(tuple(r) for r in Q.judge(docs, rules=Q.RULES).collect())
    b = sorted(tuple(r) for r in Q.judge(docs, rules=Q.RULES[::-1]).collect())
    assert a == b


def test_order_is_by_rejections_per_second(spark, frame, monkeypatch):
    monkeypatch.setattr(Q, "profile", lambda *a: [
        {"rule": "symbols", "rows": 9, "rejected": 1, "seconds": 1.0},
        {"rule": "shouting", "rows": 9, "rejected": 8, "seconds": 1.0},
        {"rule": "capitals", "rows": 9, "rejected": 8, "seconds": 0.5},
    ])
    assert [r.name for r in Q.ordered(frame([(1, "x")]))][:3] == ["capitals", "shouting", "symbols"]


def test_empty_null_ids_and_clashing_columns(spark, frame):
    docs = frame([(None, "a b"), (1, None), (1, None), (2, "good words of a text that is long enough to be kept here")])
    out = Q.keep_good(docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_words"]
    assert [r.doc_id for r in out.collect()] == [2]
    assert Q.judge(docs).count() == 4
    assert Q.judge(docs.limit(0)).collect() == []


def test_query_against_sql(matches_sql):
    matches_sql("op10_quality_rules")
