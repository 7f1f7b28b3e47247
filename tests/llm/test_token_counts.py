import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from daypanel.llm import token_counts as T


@pytest.fixture(scope="module")
def exact():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(T.MODEL))


def test_counts_are_those_of_the_named_library(exact):
    rng = random.Random(5)
    pools = [
        "abcdefghijklmnopqrstuvwxyz   ", "aab ", "  ▁\n\t", "the of and ing tion er re st ", "éàüß ñ", "中文字日本 ", "0123456789 .,;",
        "🎉🚀‍ x", "<s></s><unk><0x41> ", "\x00\x01\x7f\x85\xa0 ", "(){}[]=+-*/_",
    ]
    texts = ["", " ", "   ", "<s>", "hello  world", "a" * 3000, "ab" * 2000, " " * 100, "=" * 999, "▁a ▁", "xy" * 40 + "z"]
    for _ in range(3000):
        pool = rng.choice(pools) if rng.random() < 0.6 else "".join(rng.sample(pools, 3))
        texts.append("".join(rng.choice(pool) for _ in range(rng.randint(0, 80))))
    want = [len(x) for x in exact.encode(texts, num_threads=1)]
    got = T.count_tokens(pa.array(texts), T.vocabulary(T.MODEL)).tolist()
    assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b] == []


def test_frame_with_nulls_and_long_texts(spark, frame, exact):
    rows = [(1, None), (1, None), (2, ""), (None, "ein Wort"), (3, "word " * 9000), (4, "q" * 20000)]
    got = sorted(tuple(map(str, r)) for r in T.token_counts(frame(rows)).collect())
    want = []
    for d, t in rows:
        n = len(exact.encode(t or ""))
        want.append(tuple(map(str, (d, len((t or "").encode()), n, n > 4096))))
    assert got == sorted(want)
    assert T.token_counts(frame(rows).limit(0)).collect() == []


def test_any_pattern_takes_linear_time(exact):
    import time

    vocab = T.vocabulary(T.MODEL)
    for pattern in [" ", "a", "=", "-", "0", "\n", "日", "ab", " a", "a ", "  a", "é", "▁", "..", "e", " \n"]:
        text = pattern * (500_000 // len(pattern.encode()))
        began = time.perf_counter()
        assert T.count_tokens(pa.array([text]), vocab)[0] == len(exact.encode(text)), pattern
        assert time.perf_counter() - began < 10, pattern


def test_merging_in_order_gives_the_same(exact, monkeypatch):
    monkeypatch.setattr(T, "LONG", 1)
    monkeypatch.setattr(T, "SLOW", 1 << 40)
    rng = random.Random(6)
    texts = [" " * n for n in range(1, 120)] + [" " * n + "the=" * 3 for n in range(1, 60)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 400))) for pool in ("  ab", "=-* ", "thein ", "éa日 ", "0a.,") for _ in range(60)]
    got = T.count_tokens(pa.array(texts), T.vocabulary(T.MODEL)).tolist()
    assert got == [len(x) for x in exact.encode(texts, num_threads=1)]
