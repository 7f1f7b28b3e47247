import hashlib
import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from daypanel.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in text if c in "0123456789"])):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: sum(c in "0123456789" for c in s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= digits(m.group()) <= 19 and luhn(m.group())],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= digits(m.group()) <= 15],
    }


def base_of(texts):
    found = pii.find(pa.array(texts, pa.string()))
    out = [{k: [] for k in pii.KINDS} for _ in texts]
    for o, k, s, e, own in zip(found.owner, found.kind, found.start, found.end, found.base):
        if own:
            out[o][pii.KINDS[k]].append((int(s), int(e)))
    return out


def added(text):
    found = pii.find(pa.array([text], pa.string()))
    return [(pii.KINDS[k], text[s:e], n) for k, s, e, own, n in zip(found.kind, found.start, found.end, found.base, found.normal) if not own]


TEXTS = [
    None, "", "a@b.c", "a@b", "@b.c", "a@@b.c", "x a.b+c%d@e-f.g.h..i z", "a@b.c_d@e.f", "a@b.c@d.e", "é@b.c éa@b.c",
    "1.2.3.4", "1.2.3.4.5.6.7.8.9", "01.002.0003.255", "256.1.1.1.1", "1..2.3.4.5", "1.2.3", ".1.2.3.4.",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "41111111111111112", "4111  1111 1111 1111", "0 0",
    "+1 (752) 555-7047", "+1 (752) 555-70", "++12345678+12345678-", "+1", "+12", "+1 ( ) . -2", "+1234567890123456", "end +49 30 1234567",
    "+4111111111111111 and ü +1.2.3.4.5.6.7.8", "4995154084748072 that", "a" * 50 + "@" + "b." * 20 + "c",
]


def test_base_equals_the_patterns():
    assert base_of(TEXTS) == [brute(t) for t in TEXTS]


def test_base_on_random_strings():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for alphabet in
             ("a@.b-_", "01.9 -", "+1 9(.-)a", "1234567890 -", "é1.@a+ 5\n") for _ in range(1500)]
    texts += [" ".join(rnd.choice(TEXTS[2:]) for _ in range(5)) for _ in range(300)]
    assert base_of(texts) == [brute(t) for t in texts]


def test_disguises_map_back_to_their_source():
    for text, kind, source, normal in [
        ("write to kang.42 [at] mail8 [dot] example [dot] com today", "email", "kang.42 [at] mail8 [dot] example [dot] com", "kang.42@mail8.example.com"),
        ("kang(at)mail.example.com", "email", "kang(at)mail.example.com", "kang@mail.example.com"),
        ("so kang AT mail DOT example DOT com.", "email", "kang AT mail DOT example DOT com", "kang@mail.example.com"),
        ("ask kang.42 at mail8.example.com today", "email", "kang.42 at mail8.example.com", "kang.42@mail8.example.com"),
        ("ask kang dot 42 at mail8 dot example dot com", "email", "kang dot 42 at mail8 dot example dot com", "kang.42@mail8.example.com"),
        ("ip 65[.]231[.]209[.]153", "ip", "65[.]231[.]209[.]153", "65.231.209.153"),
        ("kang_at_mail_dot_com", "email", None, None),
        ("ü kаng＠mаil．cоm ü", "email", "kаng＠mаil．cоm", "kang@mail.com"),
        ("ka​ng@ma­il.com", "email", "ka​ng@ma­il.com", "kang@mail.com"),
        ("a kang @ mail.com", "email", "kang @ mail.com", "kang@mail.com"),
        ("kang&#64;mail&#46;com", "email", "kang&#64;mail&#46;com", "kang@mail.com"),
        ("ip 10 dot 20 dot 30 dot 40!", "ip", "10 dot 20 dot 30 dot 40", "10.20.30.40"),
        ("ip １０.２０.３０.４０", "ip", "１０.２０.３０.４０", "10.20.30.40"),
        ("at one nine two dot one six eight dot zero dot one now", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
        ("card four one one one 1111 one one one one 1111 ok", "card", "four one one one 1111 one one one one 1111", "4111 1111 1111 1111"),
        ("card 4lll-1111-1111-111l ok", "card", None, None),
        ("card 41I1-1l11-1111-1111 ok", "card", "41I1-1l11-1111-1111", "4111-1111-1111-1111"),
        ("call plus one seven five two 555-7047 now", "phone", "plus one seven five two 555-7047", "+1752 555-7047"),
        ("call plus 1 (752) 555-7047 now", "phone", "plus 1 (752) 555-7047", "+1 (752) 555-7047"),
        ("call +1 (752) five five five-7O47", "phone", "+1 (752) five five five-7O47", "+1 (752) 555-7047"),
        ("call +٤٩ 30 1234567", "phone", "+٤٩ 30 1234567", "+49 30 1234567"),
        ("call +1 (752) 555‑7047", "phone", "+1 (752) 555‑7047", "+1 (752) 555-7047"),
    ]:
        if source is not None:
            assert (kind, source, normal) in added(text), (text, added(text))


def test_prose_stays_clean():
    for text in ["look at the dot product of two vectors", "we met at example.com yesterday", "version 2.0 at example.com", "it ended. at example.com", "(2) at example.com", "one two and three at six", "plus 10 000 000 euros de plus",
                 "see section (a) of v1.2.3, at 5 dot 5", "un deux trois nous irons", "acht null drei vier", "5 plus 5", "la société – né en 1990 – compte 1 200 personnes",
                 "привет, мир", "Ελλάδα", "x | y | z 1 | 2"]:
        assert added(text) == [], (text, added(text))


def test_base_spans_stay_beside_added_ones():
    text = "a@b.c [dot] de and +1 (752) 555-7047"
    found = pii.find(pa.array([text]))
    assert [(pii.KINDS[k], text[s:e], bool(own)) for k, s, e, own in zip(found.kind, found.start, found.end, found.base)] == [
        ("email", "a@b.c", True), ("email", "a@b.c [dot] de", False), ("phone", "+1 (752) 555-7047", True)]


def test_linear_on_hostile_texts():
    for text in ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000, "@" * 400_000, " " * 400_000,
                 "one " * 100_000, " dot" * 100_000, "a at " * 80_000, "(" * 400_000, "l1" * 200_000, "a.b@" * 100_000, "​" * 400_000]:
        began = time.perf_counter()
        pii.find(pa.array([text]))
        assert time.perf_counter() - began < 6, text[:10]


def test_frame_with_nulls_ties_and_clashing_names(spark, frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a@b.c"), (None, "a@b.c"), (3, None)]
    docs = frame(rows).withColumn("spans", F.lit("x")).withColumn("t", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("a.b", F.lit(3))
    got = pii.detect(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 3)}
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        want = brute(t)
        assert [by_id[i][f"n_{k}"] for k in pii.KINDS] == [len(want[k]) for k in pii.KINDS]
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert by_id[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(by_id[i].spans.split(","))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert {r.text for r in out.where("doc_id is null").collect()} == {"<email>"}
    assert pii.spans(docs).where("kind = 'email' and doc_id = 2").collect()[0].source == "a@b.c"
    assert pii.detect(docs.limit(0)).collect() == [] and pii.redact(docs.limit(0)).collect() == []


def test_query_on_the_small_table(spark):
    from daypanel.llm.queries import LLM_QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = LLM_QUERIES["op11_pii"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in want[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS]
