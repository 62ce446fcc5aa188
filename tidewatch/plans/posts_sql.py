"""Queries on documents and conversations as posts: feeds, search, keywords, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import STOP_WORDS, detect_language, detect_source_language
from ..operators import activity, entities, fingerprints
from ..operators.posts import FeedQuery, document_posts, feed, last_write_wins, search, top_tokens, upsert_posts
from ..operators.store import VersionedTables
from ..session import load, scratch_folder
from ..sources.flatten import ingest_report


def feed_recent(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    read = posts.filter("doc_id % 3 = 0").select("id")
    return feed(posts, FeedQuery(since="2024-01-30 18:00:00", sources=("src0", "src3", "src7")), read=read).select("doc_id", "source")


def feed_bookmarked(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    return feed(posts, FeedQuery(order="engaged"), bookmarked=posts.filter("doc_id % 10 = 0").select("id")).select("doc_id", "likes")


def search_posts(spark, sf_dir):
    return search(document_posts(spark, sf_dir), "The ERTION and", F.col("body")).select("doc_id")


def conversation_topics(spark, sf_dir):
    """Conversations as topics: turns, roles and the first text."""
    c = load(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.size(F.collect_set("role")).alias("roles"), F.min_by(F.length("text"), "turn").cast("long").alias("first_chars"))


def hot_keywords(spark, sf_dir):
    """The report of the twelve most common words."""
    return activity.hot_keywords(document_posts(spark, sf_dir).withColumn("topic", F.col("lang")), F.col("body"))


def keyword_counts(spark, sf_dir):
    return activity.hot_keywords(document_posts(spark, sf_dir).withColumn("topic", F.col("lang")), F.col("body"), limit=None)


def post_tokens(spark, sf_dir):
    return top_tokens(document_posts(spark, sf_dir)).select("id", "token", "n", "place")


def post_keywords(spark, sf_dir):
    return fingerprints.top_keywords(document_posts(spark, sf_dir)).select("id", "token", "df", "place")


def simhashes(spark, sf_dir):
    return fingerprints.simhash(document_posts(spark, sf_dir)).select("id", F.col("simhash"))


def language_centroids(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    members = fingerprints.simhash(posts).join(posts.select("id", F.col("lang").alias("topic")), "id")
    return fingerprints.centroids(members)


DICTIONARY = [("erth", ["erth"]), ("tion", ["tion", "tions"]), ("that-the", ["that the", "the that"]), ("quell", ["que le"]), ("und", ["und"]), ("ciónue", ["Ciónue", "ciones"])]


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dictionary = spark.createDataFrame(DICTIONARY, "slug string, aliases array<string>")
    return entities.extract_entities(document_posts(spark, sf_dir), entities.aliases_of(dictionary), F.col("body"))


def post_entities(spark, sf_dir):
    return _mentions(spark, sf_dir).select("id", F.array_join("entities", ",").alias("entities"))


def entity_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("posts"))


def _again(spark, sf_dir):
    """Two thirds of the posts, and all even ones again with another body and more or fewer likes."""
    posts = document_posts(spark, sf_dir).select("id", "doc_id", "source", "body", "likes", "published_at")
    changed = F.concat(F.lit("new "), F.coalesce("body", F.lit("")))
    return posts.filter("doc_id % 3 <> 0"), posts.filter("doc_id % 2 = 0").withColumn("body", changed).withColumn("likes", F.col("likes") + F.col("doc_id") % 5 - 2)


def archive_upsert(spark, sf_dir):
    stored, fresh = _again(spark, sf_dir)
    return upsert_posts(stored, fresh).select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), "likes")


def upsert_partitions(spark, sf_dir):
    """The same in a store of parts by id: two batches are committed, of which the second rewrites the parts that it touches."""
    stored, fresh = _again(spark, sf_dir)
    store = VersionedTables(spark, scratch_folder(spark, "store"))
    for number, rows in enumerate((stored, fresh)):
        batch = store.batch(number)
        batch.upsert("posts", rows, upsert_posts, parts=16)
        batch.commit()
    return store.read("posts").select("doc_id", F.md5(F.col("body").cast("binary")).alias("body_md5"), "likes")


def archive_trends(spark, sf_dir):
    """The last write of each source wins, the first time stays."""
    posts = document_posts(spark, sf_dir).select("source", F.unix_millis("published_at").alias("at_ms"), "doc_id", F.unix_millis("published_at").alias("first_ms"))
    keyed = posts.withColumn("order", F.struct("at_ms", "doc_id"))
    return last_write_wins(keyed.filter("doc_id % 2 = 0"), keyed.filter("doc_id % 2 = 1"), ["source"], "order", ("first_ms",)).select("source", "doc_id", "first_ms")


def ingest_counts(spark, sf_dir):
    posts = document_posts(spark, sf_dir)
    return ingest_report(posts.filter("doc_id % 2 = 0"), posts.filter("doc_id % 3 = 0")).drop("touched")


def translation_list(spark, sf_dir):
    texts = load(spark, sf_dir, "documents").select("text")
    cache = load(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select("text")
    return entities.untranslated(texts, cache, detect_language(F.col("text")), "en").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))


def translation_batches(spark, sf_dir):
    """Texts that aren't known to be English, each with whether its batch is within sixteen and all other batches of its part but one are full."""
    docs = load(spark, sf_dir, "documents")
    todo = entities.untranslated(docs.select("text"), docs.filter("doc_id % 7 = 0").select("text"), detect_source_language(F.col("text")), "en")
    dealt = entities.translation_batches(todo, 16)
    sizes = dealt.groupBy("part", "batch").agg(F.count("*").alias("n")).groupBy("part").agg(((F.max("n") <= 16) & (F.count_if(F.col("n") < 16) <= 1)).alias("full"))
    return dealt.join(sizes, "part").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "full")


_ALL = (feed_recent, feed_bookmarked, search_posts, conversation_topics, hot_keywords, keyword_counts, post_tokens, post_keywords, simhashes, language_centroids, post_entities, entity_mentions, archive_upsert, upsert_partitions, archive_trends, ingest_counts, translation_list, translation_batches)
QUERIES = {f.__name__: f for f in _ALL}

NORM = "trim(regexp_replace(regexp_replace(translate(regexp_replace(lower(strip_accents({0})), 'https?://[^\\s]+', ' ', 'g'), '‘’“”', ''''''''''), '[^a-z0-9''\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"
_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
TOKENS = f"list_filter(list_transform(string_split({NORM}, ' '), lambda t: regexp_replace(t, '^[-'']+|[-'']+$', '', 'g')), lambda t: length(t) >= {{1}} AND NOT list_contains({_STOPS}, t) AND NOT regexp_matches(t, '^\\d$'))"
_DOCS = "d AS (SELECT *, source || ':' || doc_id AS id, n_chars % 97 AS likes, 1706659200000 - (doc_id * 7919 % 43200) * 1000 AS ms FROM documents)"
_TOK = f"{_DOCS}, k AS (SELECT id, lang, token, count(*) AS n FROM (SELECT id, lang, unnest({TOKENS.format('text', 3)}) AS token FROM d) GROUP BY ALL)"
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(token, ''), lambda c: ascii(c)::HUGEINT)), lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_BITS = f"{_TOK}, h AS (SELECT token, {_FNV} AS h FROM (SELECT DISTINCT token FROM k)), v AS (SELECT id, b, sum(CASE WHEN (h // (2::HUGEINT ** b)::HUGEINT) % 2 = 1 THEN n ELSE -n END) > 0 AS on_ FROM k JOIN h USING (token), range(64) r(b) GROUP BY id, b)"
_WHOLE = "(s - CASE WHEN s >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT"
_ALIAS = "(VALUES ('erth', 'erth'), ('tion', 'tion'), ('tion', 'tions'), ('that-the', 'that the'), ('that-the', 'the that'), ('quell', 'que le'), ('und', 'und'), ('ciónue', 'cionue'), ('ciónue', 'ciones')) e(slug, alias)"
_HIT = f"{_DOCS}, m AS (SELECT DISTINCT id, slug FROM (SELECT id, ' ' || {NORM.format('text')} || ' ' AS t FROM d), {_ALIAS} WHERE contains(t, ' ' || alias || ' '))"
_HOT = f"SELECT word, count(*) AS posts, count(DISTINCT source) AS sources, count(DISTINCT lang) AS topics FROM (SELECT id, source, lang, unnest(list_distinct({TOKENS.format('text', 4)})) AS word FROM d) GROUP BY word"
_UPSERTED = """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'new ' || coalesce(text, '') ELSE text END) AS body_md5,
  CASE WHEN doc_id % 2 <> 0 THEN likes WHEN doc_id % 3 <> 0 THEN greatest(likes, likes + doc_id % 5 - 2) ELSE likes + doc_id % 5 - 2 END AS likes FROM d WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0"""
ORACLES = {
    "feed_recent": f"WITH {_DOCS} SELECT doc_id, source FROM d WHERE ms >= 1706637600000 AND source IN ('src0', 'src3', 'src7') AND doc_id % 3 <> 0",
    "feed_bookmarked": f"WITH {_DOCS} SELECT doc_id, likes FROM d WHERE doc_id % 10 = 0",
    "search_posts": f"WITH {_DOCS} SELECT doc_id FROM d WHERE len(list_intersect(string_split({NORM.format('text')}, ' '), ['the', 'ertion', 'and'])) = 3",
    "conversation_topics": "SELECT conv_id, count(*) AS turns, count(DISTINCT role)::INT AS roles, length(arg_min(text, turn))::BIGINT AS first_chars FROM conversations GROUP BY conv_id",
    "hot_keywords": f"WITH {_DOCS} SELECT word, posts, sources::INT AS sources, topics::INT AS topics FROM ({_HOT}) ORDER BY posts DESC, sources DESC, word LIMIT 12",
    "keyword_counts": f"WITH {_DOCS} SELECT word, posts, sources::INT AS sources, topics::INT AS topics FROM ({_HOT})",
    "post_tokens": f"WITH {_TOK} SELECT id, token, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS place FROM k) WHERE place <= 5",
    "post_keywords": f"WITH {_TOK}, c AS (SELECT token, count(*) AS df FROM k GROUP BY token), s AS (SELECT id, token, df, row_number() OVER (PARTITION BY id ORDER BY round(n * (0.35::DOUBLE + 0.65::DOUBLE / (1 + ln(1 + df))) + length(token) * 0.02::DOUBLE, 9) DESC, token) AS place FROM k JOIN c USING (token)) SELECT id, token, df, place::INT AS place FROM s WHERE place <= 6",
    "simhashes": f"WITH {_BITS}, w AS (SELECT id, sum(CASE WHEN on_ THEN (2::HUGEINT ** b)::HUGEINT ELSE 0 END)::HUGEINT AS s FROM v GROUP BY id) SELECT id, {_WHOLE} AS simhash FROM w",
    "language_centroids": f"WITH {_BITS}, c AS (SELECT lang AS topic, b, 2 * count(*) FILTER (on_) >= count(*) AS on_ FROM v JOIN d USING (id) GROUP BY lang, b), w AS (SELECT topic, sum(CASE WHEN on_ THEN (2::HUGEINT ** b)::HUGEINT ELSE 0 END)::HUGEINT AS s FROM c GROUP BY topic) SELECT topic, {_WHOLE} AS centroid FROM w",
    "post_entities": f"WITH {_HIT} SELECT id, string_agg(slug, ',' ORDER BY slug) AS entities FROM m GROUP BY id",
    "entity_mentions": f"WITH {_HIT} SELECT slug AS entity, count(*) AS posts FROM m GROUP BY slug",
    "archive_upsert": f"WITH {_DOCS} {_UPSERTED}",
    "upsert_partitions": f"WITH {_DOCS} {_UPSERTED}",
    "archive_trends": f"WITH {_DOCS} SELECT source, arg_max(doc_id, (ms, doc_id)) AS doc_id, min(ms) AS first_ms FROM d GROUP BY source",
    "ingest_counts": f"WITH {_DOCS} SELECT count(*) AS fetched, count(*) FILTER (doc_id % 3 <> 0) AS inserted, count(*) FILTER (doc_id % 3 = 0) AS duplicates, 0::INT AS errors FROM d WHERE doc_id % 2 = 0",
}
