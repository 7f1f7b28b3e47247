"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from daypanel.llm import (
    collocations, decontaminate, html_extract, lm_score, merkle, ngram_join, packing, pii, quality_model, quality_rules, suffix_dedup, token_counts, url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    LLM_QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query
def op2_token_counts(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"))


@query
def op3_url_filter(spark, sf):
    pages = table(spark, sf, "pages")
    return url_filter.judge(pages, url_filter.pages_of_labelled(pages, table(spark, sf, "labels")))


LLM_ORACLE["op3_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(rest, ''), '^[^?#]*\?([^#]*)', 1) AS query
  FROM cut
),
params AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS ps
  FROM parts
),
keyed AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/index\.html?)?/*$', '')
    || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS key,
    try_cast(regexp_extract(path, '/([0-9]{1,18})', 1) AS BIGINT) AS number
  FROM params
),
listed AS (
  SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL AND number IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)
),
judged AS (
  SELECT page_id, host, path, key IS NOT NULL AND key IN (SELECT key FROM listed) AS listed, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM keyed
)
SELECT page_id, host, path, rule, listed, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query
def op4_html_extraction(spark, sf):
    return html_extract.extract(table(spark, sf, "pages"))


@query
def op5_suffix_dedup(spark, sf):
    return suffix_dedup.removed(table(spark, sf, "documents"))


@query
def op6_ngram_join(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query
def op7_benchmark_decontamination(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op8_quality_classifier(spark, sf):
    return quality_model.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_lm_scoring(spark, sf):
    return lm_score.scores(table(spark, sf, "documents"), table(spark, sf, "labels"), leave_out=True)


@query
def op10_quality_rules(spark, sf):
    return quality_rules.judge(table(spark, sf, "documents"))


LLM_ORACLE["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT doc_id, p, array_to_string(ws[p : p + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5)
),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
rows_ AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM rows_ GROUP BY doc_id),
base AS (
  SELECT doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT 10 * n_symbols > n_words
  AND NOT 10 * len(list_filter(ws, lambda x: suffix(x, '!!'))) > n_words
  AND NOT 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]', '', 'g'))
  AND NOT 2 * n_dup_lines > n_lines
  AND NOT 10 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > 3 * n_words
  AND NOT word_chars > 40 * n_words
  AND NOT 2 * word_chars < 3 * n_words AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
"""


@query
def op11_pii(spark, sf):
    return pii.detect(table(spark, sf, "documents"))


@query
def op12_merkle_manifest(spark, sf):
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.manifest(table(spark, sf, "documents"), altered=(hit, {"n_chars": F.col("n_chars") + 1}))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
LLM_ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE checked AS (
  SELECT *, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(
      [xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS inverted
  FROM documents
),
hashed AS (
  SELECT doc_id, lang, sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
    CASE WHEN xor(inverted, 4294967295) % 7 = 0
      THEN sha256({" || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))}) END AS claim
  FROM checked
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
),
up AS (
  SELECT lang, 0 AS lv, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, lv, i // 2, n
),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
),
top AS (
  SELECT 0 AS lv, i, n, h FROM subroots
  UNION ALL
  SELECT lv + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 2, n
),
folded AS (
  SELECT p.doc_id, p.leaf, s.lang, s.h AS subroot, s.i AS gi, s.n AS gn, 0 AS tree, 0 AS lv, p.i, p.n, coalesce(claim, leaf) AS own, '' AS proof
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT * FROM (
    SELECT f.doc_id, f.leaf, f.lang, subroot, gi, gn, f.tree, f.lv + 1, f.i // 2, (f.n + 1) // 2,
      sha256(CASE WHEN f.i % 2 = 1 THEN coalesce(u.h, '') || own ELSE own || coalesce(u.h, '') END), proof || coalesce(u.h, '')
    FROM folded f LEFT JOIN (SELECT 0 AS tree, * FROM up UNION ALL SELECT 1, NULL, lv, i, n, h FROM top) u
      ON u.tree = f.tree AND (f.tree = 1 OR u.lang IS NOT DISTINCT FROM f.lang) AND u.lv = f.lv AND u.i = xor(f.i, 1)
    WHERE f.n > 1
    UNION ALL
    SELECT doc_id, leaf, lang, subroot, gi, gn, 1, 0, gi, gn, own, proof FROM folded WHERE n = 1 AND tree = 0
  )
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, own AS folded_root, own = root AS verified
FROM folded, (SELECT h AS root FROM top WHERE n = 1) WHERE tree = 1 AND n = 1
"""


@query
def op13_phrase_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


LLM_ORACLE["op13_phrase_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
grams AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM places, range(1, 6) r(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM often WHERE k > 1),
parts AS (
  SELECT c.lang, array_to_string(c.ws[s : s + m - 1], ' ') AS phrase, max(c.f) AS longer
  FROM candidates c, range(2, 5) a(m), range(1, 5) b(s) WHERE m < c.k AND s + m - 1 <= c.k GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, cut, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM candidates c JOIN totals t ON t.lang = c.lang JOIN range(1, 5) x(cut) ON cut < c.k
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:cut], ' ') JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1 :], ' ')
  LEFT JOIN parts p ON p.lang = c.lang AND p.phrase = c.phrase
  WHERE p.longer IS NULL OR 100 * p.longer < 100 * c.f
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM cuts)
SELECT * EXCLUDE (pick, cut) FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE pick = 1
) WHERE rank <= 2000
"""


LLM_QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    LLM_ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
