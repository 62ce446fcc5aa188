"""Queries on the stores around trends: titles, lists, flags, logs, upserts, activity, normalised items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import activity, entities, trends
from ..operators.posts import FeedQuery, document_posts, entity_timeline, event_posts, feed, posts_of_list, search_in, search_index, set_flags, unread_counts
from ..session import load
from ..sources.flatten import ingest_report, ingest_totals as totals_of
from ..sources.normalize import normalize_items
from .posts_sql import DICTIONARY, NORM, _ALIAS, _DOCS, _FNV, _HIT
from .text_sql import _COUNT
from .trends_sql import OPTIONS, _DAILY, _POSTS, _SCORED, _daily, _now, _scored, _topics


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with title, body, simhash and arrival; one in three has no title."""
    return _topics(spark, sf_dir).select(
        "topic", "id", "source", "published_at", F.when(F.col("id") % 3 > 0, F.concat_ws(" ", F.lit("What"), "topic", F.lit("did"), F.col("author").cast("string"))).alias("title"),
        F.concat(F.lit("body of "), F.col("id").cast("string")).alias("body"), (F.col("author") * F.lit(2654435761)).alias("simhash"), F.col("published_at").alias("ingested_at"), "likes", "author",
    )


def trend_titles(spark, sf_dir):
    """Titles by representative post, entity names and keywords; the reason's numbers; the newest posts' ids."""
    posts = _named(spark, sf_dir)
    now = _now(posts)
    kind, number = F.substring_index("topic", "-", 1), F.substring_index("topic", "-", -1).cast("int")
    topics = posts.select("topic").distinct().select("topic", F.array(kind, number.cast("string")).alias("keywords"), F.when(number < 5, F.array(kind)).otherwise(F.array().cast("array<string>")).alias("entities"))
    names = spark.createDataFrame([("click", "The Click"), ("view", "")], "slug string, name string")
    out = trends.described(trends.score_topics(posts, now, OPTIONS), topics, posts, names, now, OPTIONS)
    return out.select("topic", "title", F.array_join("keywords", ",").alias("keywords"), F.array_join("entities", ",").alias("entities"), F.array_join("sample_ids", ",").alias("sample_ids"), "reason_params.*")


def trend_list(spark, sf_dir):
    return trends.query_trends(_scored(spark, sf_dir), None, 10, ["rising", "emerging", "breaking", "fading"]).select("topic", "state", "score")


def trend_matches(spark, sf_dir):
    t = _scored(spark, sf_dir).withColumns({"title": F.concat(F.lit("About "), "topic"), "keywords": F.split("topic", "-"), "entities": F.array().cast("array<string>")})
    return trends.matching(t, " Click-1").select("topic")


def unannounced_trends(spark, sf_dir):
    t = _daily(spark, sf_dir)
    return trends.hot(t, t.filter("topic LIKE 'c%'").select("topic")).select("topic", "score")


def announced_next(spark, sf_dir):
    """The report of the two hot trends that are told next."""
    t = _daily(spark, sf_dir)
    return trends.hot(t, t.filter("topic LIKE 'c%'").select("topic"), 2).select("topic", "score")


def acknowledged_trends(spark, sf_dir):
    t = _scored(spark, sf_dir)
    return trends.acknowledged_kept(t, t.filter("topic LIKE '%-3'").select("topic", F.lit(True).alias("acknowledged"))).select("topic", "acknowledged")


def kept_trends(spark, sf_dir):
    """Trends after retention: old and acknowledged ones are gone."""
    t = _scored(spark, sf_dir)
    now = _now(event_posts(spark, sf_dir))
    return trends.retain_trends(t.withColumn("acknowledged", F.col("topic").rlike("[02468]$")), now, 0.05).select("topic")


def stale_topics(spark, sf_dir):
    """Topics that had posts a week ago and have none of two hours ago."""
    posts = _topics(spark, sf_dir)
    now = _now(posts)
    fresh = posts.filter(F.col("published_at") >= F.timestamp_millis(F.lit(now - 7_200_000)))
    return trends.stale(posts, fresh).select("topic", F.lit(False).alias("kept")).union(trends.with_posts(posts.select("topic").distinct(), fresh).select("topic", F.lit(True)))


def unread(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return unread_counts(posts, posts.filter("id % 4 = 0").select("id"), _now(posts) - 864_000_000).select("source", "unread")


def keyword_weights(spark, sf_dir):
    t = _scored(spark, sf_dir).withColumn("keywords", F.split("topic", "-"))
    return activity.keyword_weights(t, None)


def _configs(posts: DataFrame) -> DataFrame:
    return posts.select("source").distinct().withColumn("enabled", F.col("source") != "s4").withColumn("last_error", F.when(F.col("source").isin("s4", "s5"), F.lit("timeout")))


def source_health(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return activity.source_health(activity.source_liveness(posts, _configs(posts), _now(posts))).select("enabled", "ok", F.round("ratio", 9).alias("ratio"))


def activity_report(spark, sf_dir):
    """Posts are ingested every six hours, the last ones not yet."""
    posts, cycle = _topics(spark, sf_dir), 21_600_000
    now = _now(posts)
    due = F.unix_millis("published_at") - F.unix_millis("published_at") % cycle + cycle
    posts = posts.withColumn("ingested_at", F.when(due <= now, F.timestamp_millis(due)))
    one = activity.activity_snapshot(posts, F.col("topic"), trends.score_topics(posts, now, OPTIONS), _configs(posts), now, 60, alerts=7)
    return one.select(
        "at_ms", "level", F.col("note.code").alias("note"), "note.seconds", "last_ingest_ms", "first_error", "rate.last_minute", "rate.last_hour", "totals.items", "totals.clusters", "totals.trends", "totals.alerts", F.col("totals.sources").alias("enabled_sources"),
        F.array_join(F.transform("keywords", lambda k: F.concat_ws(":", k["word"], k["posts"], k["sources"], k["topics"])), ",").alias("keywords"),
        F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["recent"])), ",").alias("sources"), F.array_join(F.transform("highlights", lambda h: h["topic"]), ",").alias("highlights"),
    )


def upserted_points(spark, sf_dir):
    """Points of the first three quarters of the posts, then those of all: the fresh one of a minute stays."""
    posts = _topics(spark, sf_dir)
    points = lambda p: trends.trend_points(p).select("topic", "minute", "volume")
    return trends.upsert_points(points(posts.filter("id % 4 > 0")), points(posts.filter("id % 4 < 3")), 50).select("topic", F.unix_millis("minute").alias("minute_ms"), "volume")


def upserted_topics(spark, sf_dir):
    posts = _topics(spark, sf_dir)
    seen = lambda p: p.groupBy("topic").agg(F.count("*").alias("posts"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    return trends.upsert_topics(seen(posts.filter("id % 3 > 0")), seen(posts.filter("id % 3 < 2 AND k % 2 = 0"))).select("topic", "posts", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"))


def flags(spark, sf_dir):
    """Users that were flagged at first, after every event of theirs has set or cleared the flag."""
    posts = event_posts(spark, sf_dir)
    changes = posts.select(F.col("author").alias("id"), F.struct("published_at", F.col("id").alias("n")).alias("at"), (F.col("likes") % 2 == 0).alias("on"))
    return set_flags(posts.filter("author % 5 = 0").select(F.col("author").alias("id")), changes.filter("id % 3 > 0")).select("id")


def items(spark, sf_dir):
    """Documents and pages as raw records to posts."""
    docs = load(spark, sf_dir, "documents").select(
        "source", F.when(F.col("doc_id") % 4 > 0, F.col("doc_id").cast("string")).alias("external_id"), F.concat(F.lit("https://www.Example.org/d/"), F.col("doc_id").cast("string"), F.lit("/?utm_source=x&k=1#top")).alias("url"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  Title "), "source")).alias("title"), F.substring("text", 1, 1000).alias("body"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("@User "), (F.col("doc_id") % 7).cast("string"))).alias("author"), F.when(F.col("doc_id") % 6 > 0, F.timestamp_millis(F.col("doc_id") * 1000)).alias("published_at"),
        F.col("n_chars").alias("likes"), F.array(F.lit(" B"), F.col("lang"), F.lit("b")).alias("tags"), F.lit("test").alias("origin"),
    )
    aliases = entities.aliases_of(spark.createDataFrame(DICTIONARY, "slug string, aliases array<string>"))
    out = normalize_items(docs, 1_706_659_200_000, aliases, hashes=False)
    return out.select(
        "id", "external_id", "url", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "lang", F.col("author.id").alias("author_id"), F.col("author.handle").alias("handle"), F.unix_millis("published_at").alias("at_ms"), "likes",
        F.array_join("tags", ",").alias("tags"), F.array_join("entities", ",").alias("entities"),
    )


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with entities, tags, topic and handle."""
    posts = document_posts(spark, sf_dir)
    return posts.withColumns({"entities": F.array(F.concat(F.lit("e"), (F.col("doc_id") % 9).cast("string")), F.col("lang")), "tags": F.array("source"), "topic": F.col("lang"), "handle": F.concat(F.lit("@U"), (F.col("doc_id") % 11).cast("string"))})


def token_search(spark, sf_dir):
    """The search of search_posts through a table of tokens."""
    posts = document_posts(spark, sf_dir)
    return search_in(search_index(posts, F.col("body")), "The ERTION and").select("id")


def topic_feed(spark, sf_dir):
    return feed(_tagged(spark, sf_dir), FeedQuery(topic="en", topics=("src1", "e4"))).select("doc_id")


def watched_feed(spark, sf_dir):
    return feed(_tagged(spark, sf_dir), FeedQuery(), watched=spark.createDataFrame([("e2",), ("fr",), ("none",)], "entity string")).select("doc_id")


def entity_feed(spark, sf_dir):
    return entity_timeline(_tagged(spark, sf_dir), "e7").select("doc_id")


def listed_posts(spark, sf_dir):
    """Lists of handles, of authors at a source, and of entities."""
    rows = [("one", "u3"), ("one", "@U4"), ("two", "U3"), ("two", "nobody"), ("three", "src1:@u5"), ("three", "SRC2:U6"), ("four", "E7"), ("four", "u7")]
    return posts_of_list(_tagged(spark, sf_dir), spark.createDataFrame(rows, "list string, member string"), "doc_id").select("list", "doc_id")


def entity_list(spark, sf_dir):
    """Entities with their mentions and names, watched ones first."""
    found = entities.extract_entities(document_posts(spark, sf_dir), entities.aliases_of(spark.createDataFrame(DICTIONARY, "slug string, aliases array<string>")), F.col("body"))
    counts = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("posts"))
    named = entities.with_names(counts, spark.createDataFrame([("tion", "The Tion"), ("und", "Und")], "slug string, name string"))
    listed = entities.listed_entities(named.select(F.col("entity").alias("slug"), "name", "posts", (F.col("entity") == "und").alias("watch")), "T")
    return listed.select("slug", "name", "posts", "watch")


def ingest_totals(spark, sf_dir):
    """Two reports, of even and of odd documents, summed up."""
    posts = document_posts(spark, sf_dir).withColumn("topic", F.col("lang"))
    stored = posts.filter("doc_id % 3 = 0")
    both = ingest_report(posts.filter("doc_id % 2 = 0"), stored).union(ingest_report(posts.filter("doc_id % 2 = 1"), stored))
    return totals_of(both).withColumn("touched", F.array_join("touched", ","))


_ALL = (
    trend_titles, trend_list, trend_matches, unannounced_trends, announced_next, acknowledged_trends, kept_trends, stale_topics, unread, keyword_weights, source_health, activity_report, upserted_points, upserted_topics, flags,
    items, token_search, topic_feed, watched_feed, entity_feed, listed_posts, entity_list, ingest_totals,
)
QUERIES = {f.__name__: f for f in _ALL}

_SIM = "1 - bit_count(xor(a.author * 2654435761, f.author * 2654435761)) / 64.0::DOUBLE"
_FOLD = NORM.format("text")
ORACLES = {
    "trend_titles": f"""WITH {_SCORED},
o AS (SELECT p.*, CASE WHEN id % 3 > 0 THEN 'What ' || topic || ' did ' || author END AS title, now - ms > 108000000 AS outside FROM p, n),
k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY outside, ms, id) AS place FROM o),
c AS (SELECT a.*, round(({_SIM}) + CASE WHEN a.title IS NULL THEN 0.0 ELSE 0.05 END, 9) AS s FROM k a JOIN k f ON f.topic = a.topic AND f.place = 1 WHERE a.place <= 24 AND (NOT a.outside OR f.outside)),
best AS (SELECT topic, coalesce(title, 'body of ' || id) AS words FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY s DESC, outside, ms, id) AS z FROM c) WHERE z = 1),
e AS (SELECT topic, split_part(topic, '-', 1) AS kind, split_part(topic, '-', 2)::INT AS num FROM t),
l AS (SELECT topic, string_agg(id::VARCHAR, ',' ORDER BY ms DESC, id) AS sample_ids FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ms DESC, id) AS z FROM o WHERE NOT outside) WHERE z <= 8 GROUP BY topic)
SELECT topic, CASE WHEN num < 5 AND kind <> 'view' THEN CASE kind WHEN 'click' THEN 'The Click' ELSE kind END ELSE
    CASE WHEN length(words) >= 12 THEN words ELSE upper(kind[1]) || kind[2:] || ' ' || num END END AS title,
  kind || ',' || num AS keywords, CASE WHEN num < 5 THEN kind ELSE '' END AS entities, coalesce(sample_ids, '') AS sample_ids, floor(ve * 10 + 0.5) / 10 AS velocity, floor(gr * 100 + 0.5)::BIGINT AS growth, coverage AS sources, volume, 1800.0::DOUBLE AS window_min
FROM t JOIN best USING (topic) JOIN e USING (topic) LEFT JOIN l USING (topic)""",
    "trend_list": f"WITH {_SCORED} SELECT topic, state, score FROM t WHERE score >= 10 AND state <> 'quiet'",
    "trend_matches": f"WITH {_SCORED} SELECT topic FROM t WHERE contains(topic, 'click-1')",
    "announced_next": f"WITH {_DAILY} SELECT topic, score FROM t WHERE state IN ('breaking', 'emerging') AND topic NOT LIKE 'c%' ORDER BY score DESC, volume DESC, topic LIMIT 2",
    "unannounced_trends": f"WITH {_DAILY} SELECT topic, score FROM t WHERE state IN ('breaking', 'emerging') AND topic NOT LIKE 'c%'",
    "acknowledged_trends": f"WITH {_SCORED} SELECT topic, topic LIKE '%-3' AS acknowledged FROM t",
    "kept_trends": f"WITH {_SCORED} SELECT topic FROM t WHERE NOT (last_ms < now - 4320000 AND regexp_matches(topic, '[02468]$'))",
    "stale_topics": f"WITH {_POSTS} SELECT topic, max(ms) >= any_value(now) - 7200000 AS kept FROM p, n GROUP BY topic",
    "unread": f"WITH {_POSTS} SELECT source, count(*) AS unread FROM p, n WHERE ms >= now - 864000000 AND id % 4 <> 0 GROUP BY source",
    "keyword_weights": f"WITH {_SCORED} SELECT keyword, sum(volume)::BIGINT AS weight FROM (SELECT unnest(string_split(topic, '-')) AS keyword, volume FROM t) GROUP BY keyword",
    "source_health": f"WITH {_POSTS} SELECT count(DISTINCT source) FILTER (source <> 's4') AS enabled, count(DISTINCT source) FILTER (source NOT IN ('s4', 's5')) AS ok, round(count(DISTINCT source) FILTER (source NOT IN ('s4', 's5')) / count(DISTINCT source) FILTER (source <> 's4'), 9) AS ratio FROM p",
    "activity_report": f"""WITH {_SCORED}, i AS (SELECT p.* FROM p, n WHERE ms >= now - 1296000000),
w AS (SELECT kind AS word, count(*) AS posts, count(DISTINCT source) AS so FROM i WHERE length(kind) >= 4 GROUP BY kind),
v AS (SELECT source, (SELECT count(*) FROM i, n WHERE i.source = q.source AND ms >= now - 216000000) AS recent FROM (SELECT DISTINCT source FROM p) q),
ingested AS (SELECT max(ms // 21600000 * 21600000 + 21600000) FILTER (ms // 21600000 * 21600000 + 21600000 <= now) AS last FROM p, n),
freshness AS (SELECT last, (now - last) / 1000.0 AS age, CASE WHEN last IS NULL THEN 'quiet' WHEN now - last <= 5400000 THEN 'live' WHEN now - last <= 36000000 THEN 'recent' WHEN now - last <= 216000000 THEN 'stale' ELSE 'quiet' END AS level FROM ingested, n)
SELECT (SELECT now FROM n) AS at_ms, (SELECT level FROM freshness) AS level, (SELECT level FROM freshness) AS note, (SELECT CASE WHEN level = 'stale' THEN greatest(1, floor(age + 0.5))::BIGINT END FROM freshness) AS seconds, (SELECT last FROM freshness) AS last_ingest_ms, (SELECT max('timeout') FROM v WHERE source = 's5') AS first_error, (SELECT count(*) FROM i, n WHERE ms >= now - 3600000) AS last_minute, (SELECT count(*) FROM i, n WHERE ms >= now - 216000000) AS last_hour,
  (SELECT count(*) FROM p) AS items, (SELECT count(DISTINCT topic) FROM p) AS clusters, (SELECT count(*) FROM t) AS trends, 7::BIGINT AS alerts, (SELECT count(*) FROM v WHERE source <> 's4') AS enabled_sources,
  (SELECT string_agg(concat_ws(':', word, posts, so, tp), ',' ORDER BY posts DESC, so DESC, word) FROM (SELECT word, count(*) AS posts, count(DISTINCT source) AS so, count(DISTINCT topic) AS tp FROM (SELECT DISTINCT id, unnest(CASE WHEN length(topic) >= 4 THEN [topic] ELSE [] END) AS word, source, topic FROM i) GROUP BY word ORDER BY posts DESC, count(DISTINCT source) DESC, word LIMIT 12)) AS keywords,
  (SELECT string_agg(source || ':' || recent, ',' ORDER BY recent DESC, source) FROM v) AS sources,
  (SELECT string_agg(topic, ',' ORDER BY score DESC, volume DESC, topic) FROM (SELECT * FROM t WHERE state <> 'quiet' ORDER BY score DESC, volume DESC, topic LIMIT 5)) AS highlights""",
    "upserted_points": f"""WITH {_POSTS}, m AS (SELECT topic, ms // 60000 * 60000 AS minute_ms, count(*) FILTER (id % 4 > 0) AS old, count(*) FILTER (id % 4 < 3) AS new FROM p GROUP BY ALL)
SELECT topic, minute_ms, CASE WHEN new > 0 THEN new ELSE old END AS volume FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY minute_ms DESC) AS z FROM m) WHERE z <= 50""",
    "upserted_topics": """WITH p AS (SELECT event_id AS id, event_type || '-' || (json_extract_string(props, '$.k')::BIGINT % 20) AS topic, json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) // 1000 AS ms FROM events),
s AS (SELECT topic, ms, id % 3 > 0 AS old, id % 3 < 2 AND k % 2 = 0 AS new FROM p)
SELECT topic, CASE WHEN count(*) FILTER (new) > 0 THEN count(*) FILTER (new) ELSE count(*) FILTER (old) END AS posts, min(ms) AS first_ms, max(ms) AS last_ms FROM s WHERE old OR new GROUP BY topic""",
    "flags": f"""WITH {_POSTS}, c AS (SELECT author AS id, arg_max(likes % 2 = 0, (ms, id)) AS on_ FROM p WHERE author % 3 > 0 GROUP BY author)
SELECT id FROM c WHERE on_ UNION ALL SELECT DISTINCT author FROM p WHERE author % 5 = 0 AND author NOT IN (SELECT id FROM c)""",
    "items": f"""WITH r AS (SELECT doc_id, source, n_chars AS likes, lang, 'https://example.org/d/' || doc_id || '?k=1' AS token, CASE WHEN doc_id % 2 = 0 THEN trim('  Title ' || source) END AS title, nullif(trim(substring(text, 1, 1000)), '') AS body FROM documents),
h AS (SELECT *, {_FNV} AS h, ' ' || {NORM.format("trim(concat_ws(chr(10), title, body))")} || ' ' AS t FROM r),
x AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN doc_id::VARCHAR ELSE lower(printf('%x', (h - CASE WHEN h >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT)) END AS external_id, {_COUNT['es']} AS es, {_COUNT['en']} AS en FROM h),
m AS (SELECT doc_id, string_agg(DISTINCT slug, ',' ORDER BY slug) AS entities FROM x, {_ALIAS} WHERE contains(t, ' ' || alias || ' ') GROUP BY doc_id)
SELECT source || ':' || external_id AS id, external_id, token AS url, title, md5(body) AS body_md5, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN greatest(es, en) = 0 THEN 'und' WHEN es >= en THEN 'es' ELSE 'en' END) AS lang,
  source || ':' || CASE WHEN doc_id % 5 > 0 THEN 'user-' || (doc_id % 7) ELSE 'desconocido' END AS author_id, CASE WHEN doc_id % 5 > 0 THEN 'User ' || (doc_id % 7) ELSE 'desconocido' END AS handle,
  CASE WHEN doc_id % 6 > 0 THEN doc_id * 1000 ELSE 1706659200000 END AS at_ms, likes, array_to_string(list_sort(list_distinct(['b', lang])), ',') AS tags, coalesce(entities, '') AS entities FROM x LEFT JOIN m USING (doc_id)""",
    "token_search": f"WITH {_DOCS} SELECT id FROM d WHERE len(list_intersect(string_split({_FOLD}, ' '), ['the', 'ertion', 'and'])) = 3",
    "topic_feed": "SELECT doc_id FROM documents WHERE lang = 'en' AND (source = 'src1' OR doc_id % 9 = 4)",
    "watched_feed": "SELECT doc_id FROM documents WHERE doc_id % 9 = 2 OR lang = 'fr'",
    "entity_feed": "SELECT doc_id FROM documents WHERE doc_id % 9 = 7",
    "listed_posts": """SELECT l AS list, doc_id FROM documents JOIN (VALUES ('one', 3), ('one', 4), ('two', 3)) m(l, r) ON doc_id % 11 = r UNION ALL SELECT 'three', doc_id FROM documents WHERE source = 'src1' AND doc_id % 11 = 5 OR source = 'src2' AND doc_id % 11 = 6
UNION ALL SELECT 'four', doc_id FROM documents WHERE doc_id % 9 = 7 OR doc_id % 11 = 7""",
    "entity_list": f"WITH {_HIT}, c AS (SELECT slug, CASE slug WHEN 'tion' THEN 'The Tion' WHEN 'und' THEN 'Und' ELSE slug END AS name, count(*) AS posts, slug = 'und' AS watch FROM m GROUP BY slug) SELECT * FROM c WHERE contains(lower(name), 't')",
    "ingest_totals": "SELECT count(*) AS fetched, count(*) FILTER (doc_id % 3 <> 0) AS inserted, count(*) FILTER (doc_id % 3 = 0) AS duplicates, 0::BIGINT AS errors, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS touched FROM documents",
}
