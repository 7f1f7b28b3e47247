import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from daypanel.llm import merkle as M


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    return [x[0] for lv, nodes in enumerate(tree[:-1]) for x in [[nodes[j] for j in (i >> lv ^ 1,) if j < len(nodes)]] if x]


def brute(rows):
    """(doc_id, source, lang, n_chars, text) rows to {leaf: (subroot, root, siblings)}, by explicit trees."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    hashed = lambda r: h(*map(field, r))
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([hashed(r) for r in sorted(by_lang[g], key=lambda r: (r[0] is not None, r[0] or 0, hashed(r)))]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    return {
        node: (trees[g][-1][0], top[-1][0], siblings(trees[g], i) + siblings(top, k))
        for k, g in enumerate(langs) for i, node in enumerate(trees[g][0])
    }


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def altered():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0, {"n_chars": F.col("n_chars") + 1}


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    return [(ids.pop(), rng.choice(["s", None, "sö"]), g, rng.choice([None, 5, -7]), rng.choice(["", None, "täxt", "a:b"])) for g, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("limit", [2, 10])
def test_against_explicit_trees(spark, limit):
    rows = rows_of({"en": 37, "de": 1, None: 2, "é": 16, "fr": 9, "": 3, "=x": 5})
    want = brute(rows)
    got = M.manifest(documents(spark, rows), altered=altered(), with_proof=True, limit=limit).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    chars = {r[0]: r[3] for r in rows}
    import zlib

    for r in got:
        subroot, root, proof = want[r.leaf]
        assert (r.subroot, r.root, r.proof) == (subroot, root, proof)
        assert r.proof_sha256 == h(*proof)
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and chars[r.doc_id] is not None
        assert r.verified == (not hit) == (r.folded_root == root)


def test_sizes_of_one_group(spark):
    for n in (1, 2, 3, 5, 8):
        rows = rows_of({"en": n}, n)
        got = M.manifest(documents(spark, rows), with_proof=True).collect()
        want = brute(rows)
        assert all((r.subroot, r.root, r.proof) == want[r.leaf] and r.verified for r in got) and len(got) == n
    assert got[0].root == got[0].subroot


def test_ties_repeated_rows_nulls_and_clashing_names(spark):
    rows = [(1, "a", "en", 3, "x"), (1, "a", "en", 3, "x"), (1, "b", "en", 3, "x"), (None, None, None, None, None), (None, "q", "en", 1, "y"), (None, "q", "en", 1, "y")]
    docs = documents(spark, rows)
    for name in ("g", "own", "pos", "items", "leaf", "a.b", "c0"):
        docs = docs.withColumn(name, F.lit("z"))
    got = M.manifest(docs, altered=altered(), keep=("doc_id", "a.b", "leaf")).collect()
    assert len(got) == len(rows) and len({r.root for r in got}) == 1 and all(r["a.b"] == "z" for r in got)
    assert {r[3] for r in got} == set(brute(rows))
    again = M.manifest(docs.repartition(5), altered=altered()).collect()
    assert {r.root for r in again} == {r.root for r in got}
    assert M.manifest(docs.limit(0)).collect() == []


def test_any_change_changes_the_root(spark):
    rows = rows_of({"en": 20, "de": 7})
    root = M.manifest(documents(spark, rows)).first().root
    for at, change in ((4, "other"), (3, 99), (1, "s2")):
        other = [tuple(change if (i, j) == (11, at) else v for j, v in enumerate(r)) for i, r in enumerate(rows)]
        assert M.manifest(documents(spark, other)).first().root != root
    assert M.manifest(documents(spark, rows[:-1])).first().root != root


def test_plan_has_no_single_task(spark):
    placed = M._placed(documents(spark, rows_of({"en": 9})).select(F.col("lang").alias("g"), F.col("doc_id").alias("o"), F.col("text").alias("own")), ["o", "own"])
    plan = placed._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_against_sql(matches_sql):
    matches_sql("op12_merkle_manifest")
