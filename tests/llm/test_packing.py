import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daypanel.llm import packing as P


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def sequential(lengths, capacity):
    """Best-fit decreasing, one piece after the other."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_plan_is_the_sequential_packing():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([7, 20, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 80))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = P.best_fit_decreasing(counts, capacity)
        bins = defaultdict(list)
        for n in counts:
            own = plan[plan[:, 0] == n]
            for r in range(counts[n]):
                _, first, per, start, off = own[np.searchsorted(own[:, 1], r, side="right") - 1]
                bins[start + (r - first) // per].append((off + (r - first) % per * n, n))
        assert len(bins) == sequential(lengths, capacity)
        for one in bins.values():
            at = 0
            for off, n in sorted(one):
                assert off == at
                at += n
            assert at <= capacity


def test_pieces_ids_and_places(spark, frame, exact):
    rng = random.Random(4)
    words = ["the", "ä", "x\n", "  ", "12", "<|endoftext|>", "don't", "中文", "🎉"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 30, 900, 4000])))) for i in range(60)]
    rows += [(70, None), (70, None), (71, ""), (None, "a b c"), (72, "y" * 30000), (73, " " * 9000)]
    docs = frame(rows)
    got = P.pack(docs).collect()
    want = defaultdict(int)
    for d, t in rows:
        ids = exact.encode(t or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 2048
        for j, s in enumerate(([0] if head else []) + list(range(head, len(ids), 2048))):
            n = head if head and s == 0 else 2048
            want[d, j, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for one in bins.values():
        at = 0
        for off, n in sorted(one):
            assert off == at
            at += n
        assert at <= 2048
    assert len(bins) == sequential([r.length for r in got], 2048)
    assert P.pack(docs.limit(0)).collect() == []


def test_ids_are_those_of_the_named_library(exact):
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3000, 0x9FFF), 10, 9, 0xA0, 0x2003, 0x1F600 + rng.randrange(80)])) for _ in range(rng.randint(0, 60)))
        assert P.token_ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids
