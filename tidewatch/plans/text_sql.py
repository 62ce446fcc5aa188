"""Queries of the text and address functions on documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators.entities import networks_of
from ..session import load, scratch_folder
from ..sources.landed import logged_posts
from .posts_sql import NORM, TOKENS


def normalized_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("norm_md5"))


def text_tokens(spark, sf_dir):
    tokens = text.tokenize(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens_md5"))


def headlines(spark, sf_dir):
    line = text.first_line(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", line.alias("line"), text.slugify(line).alias("slug"))


def guessed_languages(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.detect_language(F.col("text")).alias("guess"))


def source_languages(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.detect_source_language(F.col("text")).alias("guess"))


def canonical_urls(spark, sf_dir):
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", urls.canonical_url(u).alias("canonical"), urls.host_of(u).alias("host"), urls.is_safe(u).alias("safe"))


def canonical_queries(spark, sf_dir):
    """Addresses of pages with a query of each kind of pair: encoded, plus signs, a name alone, tracking in capitals, signs that forms leave."""
    u = F.concat(F.lit("https://www.example.org/p/?q=a%20b+c&z&%55TM_x=1&ref=2&n%C3%BC=%C3%A9~*-._&page="), F.col("page_id").cast("string"), F.lit("&at="), F.url_encode(F.coalesce("url", F.lit(""))), F.lit("#top"))
    return load(spark, sf_dir, "pages").select("page_id", urls.canonical_url(u).alias("canonical"))


def url_ids(spark, sf_dir):
    """Pages without an id of their own: the hash of the canonical address tells them apart."""
    return load(spark, sf_dir, "pages").select("page_id", urls.stable_id(F.lit("web"), F.lit(""), F.col("url")).alias("id"))


def page_texts(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.md5(text.squeeze_tags(F.col("html"), None).cast("binary")).alias("body_md5"))


NETWORKS = [("example.com", "com"), ("example.org", "org"), ("blog.ththth.example.org", "blog"), ("ample.net", "none")]


def page_networks(spark, sf_dir):
    domains = spark.createDataFrame(NETWORKS, "domain string, network string")
    return networks_of(load(spark, sf_dir, "pages").select("page_id", "url"), "url", domains, "page_id")


def logged_items(spark, sf_dir):
    """Documents as items that a log holds, their whole text for a title, read back through the log's source and its flattener."""
    folder = scratch_folder(spark, "landed-log")
    item = F.struct(F.col("doc_id").alias("id"), F.lit("story").alias("type"), F.col("source").alias("by"), F.col("text").alias("title"), F.length("text").alias("score"))
    load(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.to_json(item).alias("value")).write.text(f"{folder}/hackernews")
    posts = logged_posts(spark, folder, "hackernews", block=1 << 22)
    return posts.select(F.col("external_id").alias("doc_id"), "author", F.md5(F.col("title").cast("binary")).alias("title_md5"), "score", "message")


QUERIES = {f.__name__: f for f in (logged_items, normalized_texts, text_tokens, headlines, guessed_languages, source_languages, canonical_urls, canonical_queries, url_ids, page_texts, page_networks)}

_LINE = "trim(coalesce(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], ''))"
_SLUG = "substring(regexp_replace(trim(regexp_replace(replace({0}, '''', ''), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), 1, 64)"
_COUNT = {lang: " + ".join(f"contains(t, '{m}')::INT" for m in ms) for lang, ms in text.LANGUAGE_MARKERS.items()}
_URL = """u AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host,
  regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages),
np AS (SELECT *, list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: [url_decode(replace(split_part(p, '=', 1), '+', ' ')), url_decode(replace(CASE WHEN contains(p, '=') THEN substring(p, instr(p, '=') + 1) ELSE '' END, '+', ' '))]) AS named FROM u),
c AS (SELECT *, list_aggregate(list_transform(list_filter(named, lambda p: NOT regexp_matches(p[1], '(?i)^(utm_|ref|ref_src|fbclid|gclid|igshid|mc_cid|mc_eid|_hs)')),
  lambda p: replace(replace(replace(url_encode(p[1]) || '=' || url_encode(p[2]), '%20', '+'), '~', '%7E'), '%2A', '*')), 'string_agg', '&') AS q FROM np),
f AS (SELECT page_id, url, host, lower(scheme) || '://' || host || path || CASE WHEN coalesce(q, '') <> '' THEN '?' || q ELSE '' END AS canonical, lower(scheme) IN ('http', 'https') AS safe FROM c)"""
_GUESSES = f"SELECT doc_id, CASE WHEN greatest(es, en) = 0 THEN 'und' WHEN es >= en THEN 'es' ELSE 'en' END AS guess FROM (SELECT doc_id, {_COUNT['es']} AS es, {_COUNT['en']} AS en FROM (SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS t FROM documents))"
_MARKS = ", ".join(f"('{lang}', '{w}')" for lang, ws in text.SOURCE_MARKERS.items() for w in ws)
_HINTS = ", ".join(f"('{lang}', '{letters}', {n})" for lang, letters, n in text.LETTER_HINTS)
ORACLES = {
    "logged_items": "SELECT doc_id::VARCHAR AS doc_id, source AS author, md5(text) AS title_md5, length(text)::BIGINT AS score, NULL::VARCHAR AS message FROM documents WHERE doc_id IS NOT NULL",
    "source_languages": f"""WITH m(lang, word) AS (VALUES {_MARKS}), k AS (SELECT lang, word, CASE WHEN count(*) OVER (PARTITION BY word) = 1 THEN 2 ELSE 1 END AS n FROM m), h(lang, letters, n) AS (VALUES {_HINTS}),
w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\s''-]+', ' ', 'g'), '\\s+')) AS word FROM documents WHERE length(trim(text)) >= 12),
p AS (SELECT doc_id, lang, sum(n) AS n FROM (SELECT doc_id, k.lang, n FROM w JOIN k USING (word) UNION ALL SELECT doc_id, h.lang, n FROM documents JOIN h ON regexp_matches(lower(text), letters) WHERE length(trim(text)) >= 12) GROUP BY ALL),
b AS (SELECT doc_id, max(n) AS best FROM p GROUP BY doc_id), o AS (SELECT doc_id, min(p.lang) AS guess FROM p JOIN b USING (doc_id) WHERE n = best AND best >= 2 GROUP BY doc_id HAVING count(*) = 1)
SELECT doc_id, guess FROM documents LEFT JOIN o USING (doc_id)""",
    "normalized_texts": f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents",
    "text_tokens": f"SELECT doc_id, len(t)::INT AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format('text', 3)} AS t FROM documents)",
    "headlines": f"SELECT doc_id, line, {_SLUG.format(NORM.format('line'))} AS slug FROM (SELECT doc_id, CASE WHEN length(l) > 90 THEN rtrim(substring(l, 1, 89)) || '…' ELSE l END AS line FROM (SELECT doc_id, {_LINE} AS l FROM documents))",
    "guessed_languages": _GUESSES,
    "translation_list": f"WITH g AS ({_GUESSES}) SELECT DISTINCT md5(text) AS text_md5 FROM documents JOIN g USING (doc_id) WHERE guess <> 'en' AND text NOT IN (SELECT text FROM documents WHERE doc_id % 7 = 0)",
    "canonical_queries": "SELECT page_id, 'https://example.org/p?q=a+b+c&z=&n%C3%BC=%C3%A9%7E*-._&page=' || page_id || '&at=' || replace(replace(replace(url_encode(coalesce(url, '')), '%20', '+'), '~', '%7E'), '%2A', '*') AS canonical FROM pages",
    "canonical_urls": f"WITH {_URL} SELECT page_id, canonical, host, safe FROM f",
    "url_ids": f"""WITH {_URL} SELECT page_id, 'web:' || lower(printf('%x', (h - CASE WHEN h >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT)) AS id FROM (SELECT page_id,
  list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(canonical, ''), lambda c: ascii(c)::HUGEINT)), lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM f)""",
    "page_texts": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS body_md5 FROM pages",
    "page_networks": f"""WITH {_URL}, n(domain, network) AS (VALUES ('example.com', 'com'), ('example.org', 'org'), ('blog.ththth.example.org', 'blog'), ('ample.net', 'none'))
SELECT page_id, domain, network FROM (SELECT page_id, domain, network, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k FROM f JOIN n ON host = domain OR ends_with(host, '.' || domain)) WHERE k = 1""",
}
ORACLES["translation_batches"] = f"WITH g AS ({ORACLES['source_languages']}) SELECT DISTINCT md5(text) AS text_md5, true AS full FROM documents JOIN g USING (doc_id) WHERE (guess IS NULL OR guess <> 'en') AND text NOT IN (SELECT text FROM documents WHERE doc_id % 7 = 0 AND text IS NOT NULL)"
