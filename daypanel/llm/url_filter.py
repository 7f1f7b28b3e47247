"""URL verdicts: rules by host and path, and a list of URLs behind a blocked Bloom filter.

Listed URLs are brought to a canonical form and hashed into a blocked Bloom filter: a block has eight words
of 64 bits, and a URL sets one bit in each word of one block. A page whose canonical URL misses a bit is
not listed. The possible hits, a small part, go to an exact hash join with the list, which removes the
false positives. Only DataFrame functions are used.

The filter is a table with one row per block, built by a grouped ``bit_or``. It is broadcast when its size,
known from the number of listed URLs, is within ``BROADCAST_BYTES``, and joined by block otherwise.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is not
listed; repeated rows are judged row by row; repeated or null list entries count once or not at all; other
columns are ignored; an empty table gives an empty table, an empty list lists nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from daypanel.llm.staging import staged

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
WORDS = 8
BITS_PER_URL = 16
BROADCAST_BYTES = 8 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without trailing slash or index page, and the sorted
    parameters that matter. The scheme and the fragment do not count. Null without a host."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), ":(80|443)$", "")
    p = F.regexp_replace(path(url), r"(/index\.html?)?/*$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(h != "", F.concat(h, p, tail))


def rule_of(h: Column, p: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for v, rh, rp in reversed(ordered):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a block."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the distinct canonical URLs in column ``key``."""
    rows = listed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def _blocks(urls: int) -> int:
    return 1 << max(0, (urls * BITS_PER_URL // (64 * WORDS)).bit_length())


def probe(pages: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """Add ``maybe``: whether the filter holds all bits of ``key``."""
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    # Pages without a key are in no block; numbers below zero spread them, so that they are no hot key of the join.
    apart = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.lit(1 << 16))
    block = F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(blocks))).otherwise(apart)
    at = pages.withColumn("block", block).join(table, "block", "left")
    held = [F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col("key")))]
    maybe = F.coalesce(reduce(lambda a, b: a & b, held), F.lit(False)) & F.col("key").isNotNull()
    return at.withColumn("maybe", maybe).drop("block", *[f"w{i}" for i in range(WORDS)])


def judge(
    pages: DataFrame, listed_urls: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page.

    ``listed_urls`` has the URLs of the list in its first column. The verdict is that of the longest
    fitting rule, else block for a listed URL and allow for any other.
    """
    keys = listed_urls.select(canonical(F.col(listed_urls.columns[0])).alias("key")).where("key IS NOT NULL").distinct()
    keys = staged(keys, "listed-urls")
    blocks = _blocks(keys.count())
    table = staged(bloom_filter(keys, blocks), "bloom-filter")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    probed = probe(rows.withColumn("key", canonical(F.col("url"))), table, blocks)
    exact = keys.hint("shuffle_hash").withColumn("hit", F.lit(True))
    possible = probed.where("maybe").join(exact, "key", "left").select("page_id", "url", F.coalesce("hit", F.lit(False)).alias("listed"))
    rest = probed.where("NOT maybe").select("page_id", "url", F.lit(False).alias("listed"))
    both = rest.unionByName(possible).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")


def pages_of_labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of the pages whose document, named by the number in the path, is labelled toxic or of low quality."""
    number = F.regexp_extract(path(F.col("url")), "/([0-9]{1,18})", 1).try_cast("long")
    bad = labels.where("toxic = 1 OR quality = 0").select(F.col("doc_id").alias("number")).distinct()
    return pages.select("url", number.alias("number")).join(bad, "number").select("url")
