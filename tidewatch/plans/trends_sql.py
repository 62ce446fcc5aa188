"""Queries on the event stream as posts: trends, series, alerts, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import activity, alerts, running, trends
from ..operators.posts import dedup_posts, event_posts, latest_ms, retain
from ..operators.trends import TrendOptions
from ..session import scratch_folder, written
from ..streaming import late

#: The stream covers a month, so that all times of the defaults are sixty times as long.
OPTIONS = TrendOptions(window_ms=108_000_000, bucket_ms=7_200_000, buckets=15, baseline_ms=1_296_000_000, age_scale=60)


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by event type and key, about 500 topics."""
    return event_posts(spark, sf_dir).withColumn("topic", F.concat_ws("-", "topic", (F.col("k") % 20).cast("string")))


def _now(posts: DataFrame) -> int:
    return latest_ms(posts) or 0


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _topics(spark, sf_dir)
    return trends.score_topics(posts, _now(posts), OPTIONS)


def _shown(t: DataFrame) -> list:
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["count"])), ",")
    return ["topic", "score", "state", "reason", "velocity", "growth", "volume", "coverage", "engagement", "novelty", "cohesion", F.array_join("sparkline", ",").alias("sparkline"), sources.alias("sources")]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of topics that last a day, so that some are new."""
    posts = event_posts(spark, sf_dir).withColumn("topic", F.concat_ws("-", "topic", F.date_format("published_at", "dd")))
    return trends.score_topics(posts, _now(posts), OPTIONS)


def radar(spark, sf_dir):
    """The report of the forty best topics."""
    t = trends.radar(_scored(spark, sf_dir))
    return t.select(*_shown(t))


def trend_ranks(spark, sf_dir):
    """All topics with their rank."""
    t = trends.ranked(_scored(spark, sf_dir))
    return t.select("rank", *_shown(t))


def running_trends(spark, sf_dir):
    """All topics scored from cells: three batches are added up and retired, then every fifth post comes again with twice its likes."""
    posts, grain = _topics(spark, sf_dir), 1000
    at, cells = running.whole(_now(posts), grain), None
    for k in range(3):
        fresh = running.count_cells(posts.filter(F.col("id") % 3 == k), grain)
        cells = written(running.retire_cells(running.merge_cells(fresh, *([cells] if cells else [])), at, OPTIONS), f"cells-{k}")
    again = posts.filter("id % 5 = 0")
    cells = running.merge_cells(cells, running.count_cells(again, grain, -1), running.count_cells(again.withColumn("likes", F.col("likes") * 2), grain))
    return running.score_cells(running.retire_cells(cells, at, OPTIONS), at, OPTIONS).select(*_shown(cells))


def author_coverage(spark, sf_dir):
    """Distinct authors of each event type in the last week by merged sketches of two halves: exact number, and whether the estimate is within 6 percent."""
    posts, hour = event_posts(spark, sf_dir), 3_600_000
    since = (_now(posts) - 7 * 24 * hour) // hour * hour
    halves = [running.distinct_sketches(posts.filter(F.col("id") % 2 == k), "author", hour) for k in (0, 1)]
    exact = posts.filter(F.unix_millis("published_at") >= since).groupBy("topic").agg(F.count_distinct("author").alias("authors"))
    both = exact.join(running.distinct_since(running.merge_sketches(*halves), since), "topic")
    return both.select("topic", "authors", (F.abs(F.col("n") - F.col("authors")) <= 0.06 * F.col("authors") + 1).alias("near"))


def trend_sources(spark, sf_dir):
    return _scored(spark, sf_dir).select("topic", F.explode("sources").alias("s")).select("topic", "s.source", F.round("s.share", 9).alias("share"), F.col("s.count").alias("posts"))


def trend_series(spark, sf_dir):
    return _scored(spark, sf_dir).select("topic", F.posexplode("sparkline").alias("bucket", "posts"))


def hot_trends(spark, sf_dir):
    return trends.hot(_daily(spark, sf_dir)).select("topic", "state", "score")


def trend_points(spark, sf_dir):
    return trends.trend_points(_topics(spark, sf_dir)).select("topic", F.unix_millis("minute").alias("minute_ms"), "volume", F.round("engagement", 6).alias("engagement"))


def newest_posts(spark, sf_dir):
    return trends.newest_posts(_topics(spark, sf_dir)).select("topic", "id", "place")


MORE_RULES = [
    ("surge", "topic_surge", True, None, 0.2, None, None, None), ("one-entity", "watched_entity", True, " Click", -1.0, None, None, None), ("word", "keyword", True, "PURCHASE", 0.1, 2, ["s1", "s2"], None),
    ("in-text", "keyword", True, "user 14 ", -1.0, None, None, None), ("off", "topic_surge", False, None, -1.0, None, None, None),
]


def alert_events(spark, sf_dir):
    """Rules of every kind against the trends and the texts of their posts; one has fired a while ago and is cooling down."""
    posts = _topics(spark, sf_dir).withColumn("title", F.concat(F.lit("user "), F.col("author").cast("string"), F.lit(" came")))
    now = _now(posts)
    rules = alerts.default_rules(spark).union(spark.createDataFrame(MORE_RULES, alerts.RULE))
    scored = trends.score_topics(posts, now, OPTIONS).withColumns({"title": F.col("topic"), "keywords": F.split("topic", "-"), "entities": F.array(F.substring_index("topic", "-", 1))})
    fired = posts.filter("topic LIKE '%-1'").select(F.lit("surge").alias("rule_id"), "topic", F.lit(now - 3_600_000 // 4).alias("at_ms")).distinct()
    events = alerts.evaluate_rules(rules, scored, now, fired, posts)
    return events.select("rule_id", "kind", "topic", "title", "reason", "snapshot.score", "snapshot.volume", F.size("snapshot.sources").cast("long").alias("sources"))


def activity_rates(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    out = activity.rates(posts, _now(posts), scale=60)
    return out.select("posts", "sources", "topics", F.unix_millis("oldest").alias("oldest_ms"), F.unix_millis("newest").alias("newest_ms"), "last_minute", "last_five_minutes", "last_hour", "level")


def source_liveness(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    configs = posts.select("source").distinct().withColumn("enabled", F.lit(True)).withColumn("last_error", F.when(F.col("source") == "s5", F.lit("timeout")))
    return activity.source_liveness(posts, configs, _now(posts), 60 * 3_600_000).select("source", "recent", "ok")


def posts_per_source(spark, sf_dir):
    return activity.shares(event_posts(spark, sf_dir), "source").select("source", "posts", F.round("share", 9).alias("share"))


def posts_per_topic(spark, sf_dir):
    return _topics(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("posts"))


def author_maxima(spark, sf_dir):
    """Authors as posts that are seen again and again: first topic and source, largest metric."""
    posts = event_posts(spark, sf_dir).withColumnRenamed("id", "event").select(F.col("author").alias("id"), "event", "topic", "source", "published_at", "likes")
    return dedup_posts(posts, tie="event").select("id", "topic", "source", "likes", "seen")


def retained(spark, sf_dir):
    posts = event_posts(spark, sf_dir)
    return retain(posts, _now(posts), 7).select("id", "topic")


def hourly_counts(spark, sf_dir):
    """The windows of the stream, in batch form: closed windows of two hours by topic and source."""
    w = event_posts(spark, sf_dir).groupBy(F.window("published_at", "2 hours"), "topic", "source").agg(F.count("*").alias("posts"))
    return w.select(F.unix_millis("window.start").alias("start_ms"), "topic", "source", "posts")


def late_windows(spark, sf_dir):
    """Counts by two hours of a stream in three batches: every seventh post of the first two comes with the third, along with repeated ones; late ones correct closed windows."""
    posts, hour = event_posts(spark, sf_dir), 3_600_000
    ends = posts.agg(F.min(F.unix_millis("published_at")).alias("lo"), F.max(F.unix_millis("published_at")).alias("hi")).first()
    width = ((ends.hi or 0) - (ends.lo or 0)) // 3 + 1
    third, delayed = F.floor((F.unix_millis("published_at") - F.lit(ends.lo).cast("long")) / width), F.col("id") % 7 == 0
    folder = scratch_folder(spark, "late-windows")
    take = late.count_windows(folder, 2 * hour, 6 * hour)
    for k in range(3):
        take(posts.filter((third == k) & ~delayed if k < 2 else (third == k) | delayed | (F.col("id") % 11 == 0)), k)
        late.correct_closed(spark, folder)
    return late.window_counts(spark, folder, 2 * hour).select("start_ms", "topic", "source", "posts", "late_posts", "closed")


QUERIES = {f.__name__: f for f in (radar, trend_ranks, running_trends, author_coverage, trend_sources, trend_series, hot_trends, trend_points, newest_posts, alert_events, activity_rates, source_liveness, posts_per_source, posts_per_topic, author_maxima, retained, hourly_counts, late_windows)}

_POSTS = """p AS (SELECT event_id AS id, event_type AS kind, event_type || '-' || (json_extract_string(props, '$.k')::BIGINT % 20) AS topic, 's' || (user_id % 6) AS source, user_id AS author, epoch_us(ts) // 1000 AS ms, floor(value)::BIGINT AS likes FROM events),
n AS (SELECT max(ms) AS now FROM p)"""
_SCORED = f"""{_POSTS},
a AS (SELECT *, now - ms AS age, now - ms <= 108000000 AS inside, 14 - (now - ms) // 7200000 AS b FROM p, n),
g AS (SELECT topic, count(*) AS items, count(*) FILTER (inside) AS volume, count(DISTINCT source) FILTER (inside) AS coverage, count(*) FILTER (NOT inside AND age <= 1296000000) AS baseline,
  coalesce(sum(likes) FILTER (inside), 0)::DOUBLE AS eng, min(ms) AS first_ms, max(ms) AS last_ms, count(*) FILTER (inside AND b BETWEEN 7 AND 14) AS recent, count(*) FILTER (inside AND b BETWEEN 0 AND 6) AS previous, max(now) AS now FROM a GROUP BY topic),
x AS (SELECT *, (recent - previous) / greatest(previous, 1) AS gr, recent / 8.0 / greatest(baseline / 165.0, 0.25) AS ve, (now - first_ms) / 60000.0 AS age_min, (last_ms - first_ms) / 60000.0 AS span FROM g),
s AS (SELECT *, least(greatest(1 - greatest(now - first_ms, 0) / 1296000000.0, 0), 1) AS nov FROM x),
t AS (SELECT topic, items, volume, coverage, baseline, gr, ve, age_min, first_ms, last_ms, now,
  CASE WHEN volume = 0 THEN 0 ELSE floor(100 * least(greatest(0.34 * least(ln(1 + volume) / ln(301), 1) + 0.3 * least(ln(1 + ve) / ln(13), 1) + 0.16 * least(greatest((coverage - 1) / 4.0, 0), 1) + 0.12 * least(ln(1 + greatest(eng, 0)) / ln(50001), 1) + 0.08 * nov, 0), 1) + 0.5) END::BIGINT AS score,
  CASE WHEN coverage >= 3 AND ve >= 5 AND volume >= 25 THEN 'breaking' WHEN ve >= 2.5 AND volume >= 8 AND age_min <= 5400 THEN 'emerging' WHEN ve >= 1.6 THEN 'rising' WHEN ve < 0.6 AND age_min > 1800 THEN 'fading' ELSE 'quiet' END AS state,
  CASE WHEN coverage >= 3 AND ve >= 2.5 THEN 'multi_source' WHEN ve >= 3 THEN 'velocity_spike' WHEN age_min <= 1200 AND volume >= 5 THEN 'new_topic' ELSE 'sustained' END AS reason,
  floor(ve * 100 + 0.5) / 100 AS velocity, floor(gr * 1000 + 0.5) / 1000 AS growth, floor(eng + 0.5)::BIGINT AS engagement, floor(nov * 100 + 0.5) / 100 AS novelty,
  CASE WHEN items < 2 THEN 1.0 ELSE floor(least(greatest(1 - items / greatest(span, 1) / 12, 0), 1) * 100 + 0.5) / 100 END::DOUBLE AS cohesion FROM s),
parts AS (SELECT topic, source, count(*) AS c FROM a WHERE inside GROUP BY ALL),
buckets AS (SELECT topic, i AS bucket, coalesce(c, 0)::BIGINT AS posts FROM (SELECT topic, unnest(range(15)) AS i FROM t) LEFT JOIN (SELECT topic AS tt, b, count(*) AS c FROM a WHERE inside AND age >= 0 GROUP BY ALL) ON tt = topic AND b = i)"""
_TWICE = _SCORED.replace("floor(value)::BIGINT AS likes", "floor(value)::BIGINT * CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS likes").replace("SELECT max(ms) AS now FROM p", "SELECT (max(ms) + 999) // 1000 * 1000 AS now FROM p")
_DAILY = _SCORED.replace("(json_extract_string(props, '$.k')::BIGINT % 20)", "strftime(ts, '%d')")
ORACLES = {
    "radar": f"""WITH {_SCORED}
SELECT topic, score, state, reason, velocity, growth, volume, coverage, engagement, novelty, cohesion,
  (SELECT string_agg(posts::VARCHAR, ',' ORDER BY bucket) FROM buckets b WHERE b.topic = t.topic) AS sparkline, coalesce((SELECT string_agg(source || ':' || c, ',' ORDER BY c DESC, source) FROM parts q WHERE q.topic = t.topic), '') AS sources
FROM (SELECT * FROM t ORDER BY score DESC, last_ms DESC, topic LIMIT 40) t WHERE volume > 0""",
    "trend_ranks": f"""WITH {_SCORED}
SELECT row_number() OVER (ORDER BY score DESC, volume DESC, topic) AS rank, topic, score, state, reason, velocity, growth, volume, coverage, engagement, novelty, cohesion,
  (SELECT string_agg(posts::VARCHAR, ',' ORDER BY bucket) FROM buckets b WHERE b.topic = t.topic) AS sparkline, coalesce((SELECT string_agg(source || ':' || c, ',' ORDER BY c DESC, source) FROM parts q WHERE q.topic = t.topic), '') AS sources FROM t""",
    "running_trends": f"""WITH {_TWICE}
SELECT topic, score, state, reason, velocity, growth, volume, coverage, engagement, novelty, cohesion,
  (SELECT string_agg(posts::VARCHAR, ',' ORDER BY bucket) FROM buckets b WHERE b.topic = t.topic) AS sparkline, coalesce((SELECT string_agg(source || ':' || c, ',' ORDER BY c DESC, source) FROM parts q WHERE q.topic = t.topic), '') AS sources FROM t""",
    "author_coverage": f"WITH {_POSTS} SELECT kind AS topic, count(DISTINCT author) AS authors, true AS near FROM p, n WHERE ms >= (now - 604800000) // 3600000 * 3600000 GROUP BY kind",
    "trend_sources": f"WITH {_SCORED} SELECT topic, source, round(c / volume, 9) AS share, c AS posts FROM parts JOIN t USING (topic)",
    "trend_series": f"WITH {_SCORED} SELECT topic, bucket, posts FROM buckets",
    "hot_trends": f"WITH {_DAILY} SELECT topic, state, score FROM t WHERE state IN ('breaking', 'emerging')",
    "trend_points": f"WITH {_POSTS} SELECT topic, minute_ms, volume, engagement FROM (SELECT topic, ms // 60000 * 60000 AS minute_ms, count(*) AS volume, round(sum(likes)::DOUBLE, 6) AS engagement, row_number() OVER (PARTITION BY topic ORDER BY ms // 60000 DESC) AS k FROM p GROUP BY topic, ms // 60000) WHERE k <= 720",
    "newest_posts": f"WITH {_POSTS} SELECT topic, id, place FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY ms DESC, id) AS place FROM p) WHERE place <= 8",
    "alert_events": f"""WITH {_SCORED},
r(rule_id, kind, query, min_growth, min_sources, sources) AS (VALUES ('multi-source', 'multi_source', NULL, 2.5, 3, NULL), ('global-breaking', 'global_breaking', NULL, 4.0, 4, NULL),
  ('surge', 'topic_surge', NULL, 0.2, NULL, NULL), ('one-entity', 'watched_entity', 'click', -1.0, NULL, NULL), ('word', 'keyword', 'purchase', 0.1, 2, ['s1', 's2']), ('in-text', 'keyword', 'user 14', -1.0, NULL, NULL))
SELECT rule_id, kind, topic, topic AS title, reason, score, volume, coverage AS sources FROM r, t WHERE growth >= min_growth AND coverage >= coalesce(min_sources, 1)
  AND (r.sources IS NULL OR EXISTS (SELECT 1 FROM parts q WHERE q.topic = t.topic AND list_contains(r.sources, q.source)))
  AND CASE kind WHEN 'multi_source' THEN coverage >= coalesce(min_sources, 3) WHEN 'global_breaking' THEN state IN ('breaking', 'emerging') WHEN 'topic_surge' THEN state <> 'quiet'
    WHEN 'watched_entity' THEN split_part(topic, '-', 1) = query WHEN 'keyword' THEN contains(topic, query) OR EXISTS (SELECT 1 FROM p WHERE p.topic = t.topic AND contains('user ' || author || ' came', query)) ELSE volume >= 5 END
  AND NOT (rule_id = 'surge' AND topic LIKE '%-1')""",
    "activity_rates": f"""WITH {_POSTS} SELECT count(*) AS posts, count(DISTINCT source) AS sources, count(DISTINCT kind) AS topics, min(ms) AS oldest_ms, max(ms) AS newest_ms, count(*) FILTER (ms >= now - 3600000) AS last_minute,
  count(*) FILTER (ms >= now - 18000000) AS last_five_minutes, count(*) FILTER (ms >= now - 216000000) AS last_hour, 'live' AS level FROM p, n""",
    "source_liveness": f"WITH {_POSTS} SELECT source, count(*) FILTER (ms >= now - 216000000) AS recent, source <> 's5' AS ok FROM p, n GROUP BY source",
    "posts_per_source": f"WITH {_POSTS} SELECT source, count(*) AS posts, round(count(*) / (SELECT count(*) FROM p), 9) AS share FROM p GROUP BY source",
    "posts_per_topic": f"WITH {_POSTS} SELECT topic, count(*) AS posts FROM p GROUP BY topic",
    "author_maxima": f"WITH {_POSTS} SELECT author AS id, arg_min(kind, (ms, id)) AS topic, arg_min(source, (ms, id)) AS source, max(likes) AS likes, count(*) AS seen FROM p GROUP BY author",
    "retained": f"WITH {_POSTS} SELECT id, kind AS topic FROM p, n WHERE ms >= now - 604800000",
    "late_windows": f"""WITH {_POSTS}, e AS (SELECT min(ms) AS lo, (max(ms) - min(ms)) // 3 + 1 AS w FROM p), b AS (SELECT p.*, least((ms - lo) // w, 2) AS third, id % 7 = 0 AS delayed, ms // 7200000 * 7200000 AS start_ms FROM p, e),
m AS (SELECT max(ms) FILTER (third < 2 AND NOT delayed) - 21600000 AS mark, max(ms) - 21600000 AS last FROM b)
SELECT start_ms, kind AS topic, source, count(*) AS posts, count(*) FILTER (delayed AND start_ms + 7200000 <= mark) AS late_posts, start_ms + 7200000 <= any_value(last) AS closed FROM b, m GROUP BY start_ms, kind, source""",
    "hourly_counts": f"WITH {_POSTS} SELECT ms // 7200000 * 7200000 AS start_ms, kind AS topic, source, count(*) AS posts FROM p GROUP BY ALL",
}
