"""The queries of this subpackage by name, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, minhash, mixing, ogg, packing, rlz, simhash, suffix, urls, weaklabel


def _over(table: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": _over("documents", simhash.query),
        "op2_mixing": _over("documents", mixing.query),
        "op3_ogg": _over("documents", ogg.query),
        "op4_urls": _over("pages", urls.query),
        "op5_langid": _over("documents", langid.query),
        "op6_suffix": _over("documents", suffix.query),
        "op7_packing": _over("documents", packing.query),
        "op8_minhash": _over("documents", minhash.query),
        "minhash_near_duplicates": _over("documents", minhash.near_duplicates),
        "op9_rlz": _over("documents", rlz.query),
        "op10_weaklabel": _over("documents", weaklabel.query),
    }


def oracle_sql() -> dict[str, str]:
    """SQL where whole tables are quick in it; the others are tested against brute force in tests/llm."""
    return {"op2_mixing": OP2, "op4_urls": OP4, "op6_suffix": OP6, "op9_rlz": OP9}


OP9 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (
  SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
k AS (
  SELECT doc_id, i, words[i] AS word,
    CASE WHEN i + 19 <= len(words) THEN md5(array_to_string(words[i:i + 19], ' ')) END AS phrase FROM p),
d AS (
  SELECT doc_id, i, word,
    CASE WHEN phrase IS NOT NULL AND row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) > 1 THEN i END AS dup FROM k),
r AS (
  SELECT doc_id, i, word,
    max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM d),
s AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""

OP6 = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM t WHERE octet_length(b) >= 200),
k AS (SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS string FROM p),
d AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY string) > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 200 THEN 0 ELSE 1 END AS fresh FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 199 AS z FROM r GROUP BY doc_id, run),
u AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM s
  UNION ALL SELECT t.doc_id, coalesce(max(s.z), 0) + 1, any_value(octet_length(b)) FROM t LEFT JOIN s ON t.doc_id = s.doc_id GROUP BY t.doc_id),
kept AS (
  SELECT u.doc_id, string_agg(CASE WHEN u.a <= u.z THEN hex(array_slice(b, u.a, u.z)) ELSE '' END, '' ORDER BY u.a) AS hexed
  FROM u JOIN t ON t.doc_id = u.doc_id GROUP BY u.doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(hexed)) AS kept_sha256
FROM t JOIN kept ON t.doc_id = kept.doc_id LEFT JOIN n ON t.doc_id = n.doc_id
"""

# The SQL follows link targets with a scheme or a host; pages of these tables have no others.
OP4 = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?(?:-->|$)', '', 'gs'), '<(?:link|meta)\b[^>]*>', 0, 'i')) AS tag
  FROM pages WHERE regexp_matches(html, 'canonical|refresh', 'i')),
hrefs AS (
  SELECT url, regexp_replace(CASE
    WHEN regexp_matches(tag, '^<link.*\brel\s*=\s*["'']?canonical\b', 'is') THEN regexp_extract(tag, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')
    WHEN regexp_matches(tag, '^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b', 'is') THEN regexp_extract(tag, '\bcontent\s*=\s*["'']?\s*\d+\s*;\s*url\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'i') END,
    '&(?:amp|#38|#x26);', '&', 'gi') AS href FROM tags),
links AS (SELECT url, CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END AS target FROM hrefs),
all_urls AS (SELECT true AS page, page_id, url FROM pages UNION ALL SELECT DISTINCT false, NULL, target FROM links WHERE contains(target, '://')),
u AS (
  SELECT page, page_id, url, coalesce(translate(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 2), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^(.*?)://([^/?#]*)([^?#]*)', 3), '') AS path,
    regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1), '/(\?|$)', '\1') AS rest FROM all_urls),
rules(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT u.*, CASE WHEN contains(url, '://') THEN host || rest END AS node,
    (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
    (SELECT max_by(action, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS action
  FROM u),
edges AS (SELECT a.node AS a, b.node AS b FROM links l JOIN m a ON a.url = l.url JOIN m b ON b.url = l.target AND NOT b.page),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, peer) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.peer = e.a),
parts AS (SELECT node, min(peer) AS part FROM reach GROUP BY node),
named AS (SELECT m.*, coalesce(part, m.node) AS part FROM m LEFT JOIN parts ON parts.node = m.node),
decided AS (SELECT part, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked FROM named WHERE action IS NOT NULL GROUP BY part)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM named LEFT JOIN decided ON decided.part = named.part WHERE page
"""

_FILL = """CASE WHEN {cap} <= {lev} * {w} THEN {cap}
    ELSE CAST(floor(max(CASE WHEN {cap} > {lev} * {w} THEN {lev} END) OVER (PARTITION BY {parent}) * {w}) AS BIGINT) END"""
_LEVEL = """CAST({budget} - coalesce(CAST(sum({cap}) OVER (PARTITION BY {parent} ORDER BY {cap} / {w}, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
    / CAST(sum({w}) OVER (PARTITION BY {parent} ORDER BY {cap} / {w}, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE)"""


def _level(name: str, parent: str, budget: str) -> str:
    cap, w = f"cap_{name}", f"w_{name}"
    return _LEVEL.format(cap=cap, w=w, parent=parent, name=name, budget=budget)


def _fill(name: str, parent: str) -> str:
    return _FILL.format(cap=f"cap_{name}", w=f"w_{name}", lev="lev", parent=parent)


OP2 = rf"""
WITH n AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens,
    TRY_CAST(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,9}})$', 1) AS INT) AS k FROM documents),
d AS (SELECT doc_id, lang, source, n_tokens, CASE WHEN k = 0 THEN 'web' WHEN k <= 6 THEN 'forum' ELSE 'books' END AS domain FROM n),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap_source, 1 AS w_source,
    CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS w_lang,
    CASE domain WHEN 'web' THEN 2 WHEN 'forum' THEN 5 ELSE 3 END AS w_domain FROM d GROUP BY ALL),
b AS (SELECT CAST(floor(sum(tokens) * CAST(0.8 AS DOUBLE)) AS BIGINT) AS budget FROM leaf),
l0 AS (SELECT domain, lang, w_domain, w_lang, CAST(sum(cap_source) AS BIGINT) AS cap_lang FROM leaf GROUP BY ALL),
d0 AS (SELECT domain, w_domain, CAST(sum(cap_lang) AS BIGINT) AS cap_domain FROM l0 GROUP BY ALL),
d1 AS (SELECT *, {_level("domain", "1", "budget")} AS lev FROM d0, b),
d2 AS (SELECT domain, {_fill("domain", "1")} AS for_domain FROM d1),
l1 AS (SELECT *, {_level("lang", "domain", "for_domain")} AS lev FROM l0 JOIN d2 USING (domain)),
l2 AS (SELECT domain, lang, {_fill("lang", "domain")} AS for_lang FROM l1),
s1 AS (SELECT *, {_level("source", "domain, lang", "for_lang")} AS lev FROM leaf JOIN l2 USING (domain, lang)),
s2 AS (SELECT domain, lang, source, tokens, {_fill("source", "domain, lang")} AS allot FROM s1),
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN allot // tokens ELSE 0 END AS whole, allot - CASE WHEN tokens > 0 THEN allot // tokens ELSE 0 END * tokens AS rest FROM s2),
j AS (SELECT d.*, whole, rest, substr(md5(concat_ws(':', '11', CAST(whole AS VARCHAR), CAST(doc_id AS VARCHAR))), 1, 15) AS o FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY o, doc_id NULLS FIRST, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM j)
SELECT doc_id, domain, lang, source, CAST(whole AS INT) AS epoch, n_tokens FROM c WHERE rest > 0 AND whole < 2 AND upto <= rest
UNION ALL
SELECT doc_id, domain, lang, source, CAST(e AS INT) AS epoch, n_tokens FROM (SELECT *, unnest(range(0, whole)) AS e FROM j)
"""
