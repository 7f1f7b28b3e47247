import re

from pyspark.sql import functions as F

from daypanel.llm import url_filter as U

URLS = [
    None, "", "no scheme", "://", "http://", "http://Net/", "http://a.NET", "http://a.net/", "https://x.example.net/en/1", "https://example.net/en",
    "https://badexample.net/en/1", "http://EXAMPLE.com/de/7?x=1#y", "http://www.example.com/de/7", "http://q.org/fr/#a", "http://q.org/frx",
    "http://ÉxAmple.org/fr/1", "ftp://a.org?b/fr/", "http://a.com/x/?utm_source=f&b=2&a=1", "https://www.a.com:443/x?a=1&b=2#t", "http://a.com/x/index.html?a=1&b=2",
    "http://a.com/x?a=1", "x://y://z/p", "http://a.com/x?a=1&b=2", "http://b.com/" + "p" * 5000,
]
LISTED = ["http://a.com/x?b=2&a=1", "http://a.com/x?b=2&a=1", None, "nothing", "https://b.com/" + "p" * 5000]


def host_path(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    h = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in h), re.match(r"[^?#]*", rest[len(h) :])[0]


def rule(h, p):
    fits = [r for r in U.RULES if (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2))
    got = {r.page_id: r for r in U.judge(pages, spark.createDataFrame([(u,) for u in LISTED], "url string")).collect()}
    assert len(got) == len(URLS)
    listed = {u for u in URLS if u and (u.startswith(("http://a.com/x", "https://www.a.com")) and "b=2" in u or "ppp" in u)}
    for i, u in enumerate(URLS):
        h, p = host_path(u)
        r = rule(h, p)
        assert (got[i].host, got[i].path, got[i].rule) == (h, p, r and r[1] + r[2])
        assert got[i].listed == (u in listed)
        assert got[i].verdict == (r[0] if r else "block" if u in listed else "allow")


def test_filter_misses_nothing_and_passes_little(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = U._blocks(4000)
    probed = U.probe(spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), U.bloom_filter(keys, blocks), blocks)
    hits = {r.id for r in probed.where("maybe").collect()}
    assert set(range(4000)) <= hits and len(hits) < 4400


def test_beyond_the_broadcast_limit_and_empty(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, None)], "page_id long, url string")
    listed = pages.select("url").limit(1)
    assert sorted((r.page_id, r.verdict) for r in U.judge(pages, listed).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert U.judge(pages.limit(0), listed).collect() == []
    assert {r.verdict for r in U.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_pages_without_a_key_are_spread(spark, monkeypatch):
    """Beyond the broadcast limit the pages are shuffled by block; those without a key do not share one."""
    monkeypatch.setattr(U, "BROADCAST_BYTES", 0)
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        probed = U.probe(pages, U.bloom_filter(spark.range(9).select(F.concat(F.lit("k"), "id").alias("key")), 4), 4)
        sizes = [r["count"] for r in probed.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / len(sizes) and len(sizes) > 1
        assert not probed.where("maybe").head(1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    plan = U.judge(pages, pages.select("url"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_against_sql(matches_sql):
    matches_sql("op3_url_filter")
    matches_sql("op3_url_filter", "/root/testdata/sf0.01")
