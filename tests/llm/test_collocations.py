import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daypanel.llm import collocations as C
from daypanel.llm.staging import dropped, staged


def brute(rows, least, longest=5, top=2000):
    """(lang, text) rows to (lang, rank, phrase, a, l, r, n, score), by counting every phrase of every piece."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    held = Counter()
    for (lang, ws), a in cand.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                held[lang, ws[i : i + m]] = max(held[lang, ws[i : i + m]], a)
    out = {}
    for (lang, ws), a in cand.items():
        if 100 * held[lang, ws] >= 100 * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def texts(seed, n, words=12):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "São", "ß", "a-b", "x\x00y", "\x0b", "end", "new", "york", "city", "é", "№", "日本"][:words]
    sep = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!", ":;", " "]
    rows = []
    for _ in range(n):
        t = "".join(rng.choice(vocab) + rng.choice(sep) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None, "und", ""]), t + rng.choice(["", " new york city of the end", " new york city of the end"])))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").repartition(3)


@pytest.mark.parametrize("least, top", [(5, 2000), (12, 7), (3, None)])
def test_against_brute_force(spark, least, top):
    rows = texts(least, 150) + [("en", None), ("en", ""), ("fr", " \t .;"), ("de", "one")] + [("en", "copy of copy of copy of copy.")] * 20
    got = sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=least, top=top).collect())
    assert got == brute(rows, least, top=top or 10**9)
    assert got


def test_chunks_and_buckets_do_not_matter(spark):
    rows = texts(4, 120)
    one = sorted(tuple(r) for r in C.collocations(frame(spark, rows).coalesce(1), least=6).collect())
    many = sorted(tuple(r) for r in C.collocations(frame(spark, rows).repartition(40), least=6).collect())
    assert one == many == brute(rows, 6)


def test_shorter_and_longer_phrases(spark):
    rows = texts(9, 80)
    for longest in (2, 3):
        assert sorted(tuple(r) for r in C.collocations(frame(spark, rows), least=5, longest=longest).collect()) == brute(rows, 5, longest)


def test_empty_nulls_and_clashing_names(spark):
    docs = frame(spark, texts(2, 60))
    for name in ("t", "chunk", "seq", "id", "a.b", "n", "f"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    assert sorted(tuple(r) for r in C.collocations(docs, least=5).collect()) == brute([(r.lang, r.text) for r in docs.collect()], 5)
    assert C.collocations(docs.limit(0)).collect() == []
    assert C.collocations(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []


def test_long_texts_and_a_repeated_word(spark):
    rows = [("en", "la " * 200_000), ("en", "x" * 300_000), ("en", "," * 100_000), ("de", "a b " * 50_000)]
    got = {(r.lang, r.phrase): (r.a, r.l, r.r) for r in C.collocations(frame(spark, rows)).collect()}
    # Each length stands once less often than the one before, so no phrase of repeated words is held by one as frequent.
    assert got["en", "la la"] == (199_999, 200_000, 200_000)
    assert got["en", "la la la la la"][0] == 199_996
    assert got["de", "a b"] == (50_000, 50_000, 50_000)


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 10**13 + 9, 10**13 + 8), (99, 10**16, 100, 100), (10**12, 10**13, 10**12, 10**12)]
    df = spark.createDataFrame(rows, "f bigint, n bigint, l bigint, r bigint")
    got = [x[0] for x in df.select(F.expr(C._score("f", "n", "l", "r"))).collect()]
    assert got == [1000 * f * n // (l * r) for f, n, l, r in rows]


def test_packed_numbers_round_trip():
    import numpy as np

    for top in (0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**62):
        x = np.array([0, 1, top], dtype=np.int64)
        assert C.unpack(C.pack(x)).tolist() == x.tolist()
        assert C.unpack_rising(C.pack_rising(np.sort(x))).tolist() == sorted(x.tolist())
    assert C.unpack(C.pack(np.zeros(0, np.int64))).tolist() == []
    for n in (1, 2, 63, 64, 65, 1000):
        x = np.arange(n, dtype=np.int64) * 77_777
        assert C.unpack(C.pack(x)).tolist() == x.tolist()
    assert len(C.pack(np.array([5]))) == 2


def test_staged_tables_go(spark):
    import os

    df = staged(spark.range(5), "gone")
    path = df.staged_at.removeprefix("file:")
    assert os.path.isdir(path)
    dropped(df)
    assert not os.path.exists(path)


def test_query_against_sql(matches_sql):
    matches_sql("op13_phrase_collocations")
