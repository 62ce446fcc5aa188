"""Small cases with known results, and the operators that no table feeds."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores, text, urls
from tidewatch.operators import alerts, posts as P, trends
from tidewatch.sources import flatten
from tidewatch.streaming import live

NOW = datetime(2025, 10, 9, 8, 53, 20, tzinfo=timezone.utc)
NOW_MS = int(NOW.timestamp() * 1000)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def make_posts(spark, ages, sources=6, topic="t", likes=0):
    rows = [(f"p{i}", topic, f"s{i % sources}", NOW - timedelta(minutes=a), likes) for i, a in enumerate(ages)]
    return spark.createDataFrame(rows, "id string, topic string, source string, published_at timestamp, likes long")


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.normalize_text(F.lit("Árbol, ¿sí? http://a.example/b ¡Ya!")), "arbol si ya"),
        (lambda: text.tokenize(F.lit("we go to the IA of now or morning")), ["morning"]),
        (lambda: text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), 1 / 3),
        (lambda: text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a"))), 0.0),
        (lambda: text.hex64(text.fnv1a64(F.lit(""))), "cbf29ce484222325"),
        (lambda: text.hex64(text.fnv1a64(F.lit("a"))), "af63dc4c8601ec8c"),
        (lambda: text.hamming(F.lit(5).cast("long"), F.lit(3).cast("long")), 2),
        (lambda: text.first_line(F.lit("\n  \n one\ntwo")), "one"),
        (lambda: text.slugify(F.lit("Ñandú's Big Day!")), "nandus-big-day"),
        (lambda: text.title_from_keywords(F.array(F.lit("solar"), F.lit("wind")), F.lit("x")), "Solar Wind"),
        (lambda: text.strip_html(F.lit("<p>a &amp; b<br>c")), "a & b\nc"),
        (lambda: text.detect_language(F.lit("xyz")), "und"),
        (lambda: urls.canonical_url(F.lit("https://www.Example.org:8080/story/?utm_source=a&id=7&ref=b#top")), "https://example.org/story?id=7"),
        (lambda: urls.canonical_url(F.lit("  no url ")), "no url"),
        (lambda: urls.canonical_url(F.lit("http://a.example/x?q=a%20b&z")), "http://a.example/x?q=a+b&z="),
        (lambda: urls.canonical_query(F.lit("a=1=2&&=v&%zz=+&b=%C3%A9%2B&_HSx=1")), "a=1%3D2&=v&%25zz=+&b=%C3%A9%2B"),
        (lambda: urls.is_safe(F.lit("javascript:alert(1)")), False),
        (lambda: urls.matches_domain(F.lit("evilsite.com"), F.lit("site.com")), False),
        (lambda: urls.matches_domain(F.lit("old.site.com"), F.lit("site.com")), True),
        (lambda: scores.half_up(F.lit(-0.5)), 0.0),
        (lambda: scores.sparkline_tone(F.array(*map(F.lit, (0, 1, 5)))), ["cool", "cool", "hot"]),
        (lambda: text.normalize_tags(F.array(F.lit(" B"), F.lit("a"), F.lit("b"), F.lit(""))), ["a", "b"]),
    ],
)
def test_functions(spark, column, want):
    got = value(spark, column())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_worked_trend(spark):
    posts = make_posts(spark, [28, 26, 24, 22, 20, 18, 12, 11, 8, 8, 6, 5, 4, 3, 2, 1], sources=3)
    t = trends.score_topics(posts, NOW_MS).first()
    assert (t.volume, t.coverage, t.growth, t.cohesion) == (16, 3, 0.667, 0.95)
    assert t.sparkline == [1, 1, 1, 1, 1, 1, 0, 0, 1, 1, 2, 1, 2, 2, 1]
    assert t.velocity == 5.0


@pytest.mark.parametrize(("ages", "state"), [([i * 0.55 for i in range(20)], "emerging"), ([i * 0.25 for i in range(40)], "breaking"), ([i * 15 for i in range(24)], "quiet")])
def test_states(spark, ages, state):
    assert trends.score_topics(make_posts(spark, ages), NOW_MS).first().state == state


def test_buckets_and_old_topic(spark):
    assert sum(trends.score_topics(make_posts(spark, [1, 3, 5, 40]), NOW_MS).first().sparkline) == 3
    old = trends.score_topics(make_posts(spark, [600]), NOW_MS).first()
    assert (old.volume, old.score) == (0, 0)
    assert trends.score_topics(make_posts(spark, []), NOW_MS).count() == 0


def test_dedup_and_upsert(spark):
    rows = [("a", "t1", "x", NOW, 10), ("a", "t2", "x", NOW + timedelta(minutes=1), 99), ("b", "t1", "x", NOW, 1)]
    posts = spark.createDataFrame(rows, "id string, topic string, source string, published_at timestamp, likes long")
    got = {r.id: r for r in P.dedup_posts(posts, tie="topic").collect()}
    assert (got["a"].topic, got["a"].likes, got["a"].seen) == ("t1", 99, 2)
    up = {r.id: r for r in P.upsert_posts(posts.filter("likes < 50"), posts.filter("likes = 99")).collect()}
    assert (up["a"].topic, up["a"].likes, len(up)) == ("t2", 99, 2)


def test_retention_and_search(spark):
    posts = make_posts(spark, [1, 40 * 24 * 60]).withColumn("body", F.lit("Un Árbol grande"))
    assert P.retain(posts, NOW_MS).count() == 1
    assert P.search(posts, "ARBOL", F.col("body")).count() == 2
    assert P.search(posts, " ", F.col("body")).count() == 0


def test_cooldown(spark):
    hot = trends.score_topics(make_posts(spark, [i * 0.25 for i in range(40)]), NOW_MS)
    rules = alerts.default_rules(spark).filter("id = 'global-breaking'").withColumn("min_sources", F.lit(1)).withColumn("min_growth", F.lit(0.0))
    events = alerts.evaluate_rules(rules, hot, NOW_MS)
    assert events.count() == 1
    fired = alerts.fired_after(spark.createDataFrame([], "rule_id string, topic string, at_ms long"), events, NOW_MS)
    assert alerts.evaluate_rules(rules, hot, NOW_MS + 1000, fired).count() == 0
    assert alerts.evaluate_rules(rules, hot, NOW_MS + 1_800_000, fired).count() == 1
    assert alerts.fired_after(fired, events.limit(0), NOW_MS + 86_400_001).count() == 0


def test_flatten(spark, tmp_path):
    landed = {
        "hackernews": [{"id": 1, "type": "story", "by": "u", "title": "T", "text": "<p>x", "time": 1760000000, "score": 3, "descendants": 2}, {"id": 2, "type": "comment"}, {"id": 3, "type": "story", "dead": True}],
        "bluesky": [{"posts": [{"uri": "at://did/app.post/k1", "author": {"did": "did", "handle": "h.example"}, "record": {"text": "hello", "createdAt": "2025-01-01T00:00:00Z", "langs": ["en"]}, "likeCount": 4}]}],
        "reddit": [{"data": {"children": [{"data": {"id": "r1", "title": "A", "permalink": "/r/x/1", "subreddit": "x", "created_utc": 1760000000.0, "score": 9, "over_18": False}}, {"data": {"id": "r2", "over_18": True}}]}}],
        "mastodon": [{"id": "m1", "url": "https://m.example/1", "content": "<p>hi <b>you</b></p>", "created_at": "2025-01-01T00:00:00Z", "account": {"acct": "a"}, "favourites_count": 1, "tags": [{"name": "news"}], "instance": "m.example"}],
        "github": [{"items": [{"id": 5, "full_name": "o/r", "html_url": "https://g.example/o/r", "language": "Scala", "topics": ["a", "b", "c", "d", "e"], "stargazers_count": 7, "created_at": "2025-01-01T00:00:00Z", "owner": {"login": "o"}}]}],
        "releases": [{"repo": "o/r", "tag_name": "v1", "name": "One", "prerelease": False, "published_at": "2025-01-01T00:00:00Z", "author": {"login": "o"}}, {"repo": "o/r", "tag_name": "v2", "prerelease": True}],
    }
    frames = []
    for source, rows in landed.items():
        path = tmp_path / f"{source}.json"
        path.write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n")
        read = flatten.read_landed(spark, source, str(path))
        assert flatten.bad_records(read.cache(), source).count() == 1
        frames.append(flatten.CONNECTORS[source](read.filter("_corrupt IS NULL")))
    got = {r.external_id: r for r in flatten.union_sources(frames).collect()}
    assert set(got) == {"1", "at://did/app.post/k1", "r1", "m1", "5", "release:o/r@v1"}
    assert got["1"].url.endswith("id=1") and got["m1"].body == "hi you" and got["m1"].tags == ["mastodon", "news", "m.example"]
    assert got["5"].tags == ["scala", "a", "b", "c", "d"] and got["at://did/app.post/k1"].url == "https://bsky.app/profile/h.example/post/k1"


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>One</title><link>https://a.example/1</link><guid>g1</guid><pubDate>Wed, 01 Jan 2025 10:00:00 GMT</pubDate><description>&lt;b&gt;x&lt;/b&gt; y</description></item></channel></rss>")
    items = spark.read.schema(flatten.RSS_ITEM).format("xml").option("rowTag", "item").load(str(tmp_path / "f.xml"))
    r = flatten.rss(items, "https://a.example/feed", F.lit(NOW)).first()
    assert (r.external_id, r.body, r.published_at) == ("g1", "x y", datetime(2025, 1, 1, 10))


def test_streams(spark, tmp_path):
    def message(i, text, at, lang="en", kind="commit"):
        return json.dumps({"did": f"d{i % 2}", "time_us": int(at * 1e6), "kind": kind, "commit": {"operation": "create", "collection": "post", "rkey": str(i), "record": {"text": text, "langs": [lang], "createdAt": ""}}})

    start = NOW.timestamp()
    lines = [message(i, f"a long text about wind {i}", start + i) for i in range(5)] + [message(0, "a long text about wind 0", start), message(9, "short", start), message(8, "un texto en otra lengua", start, "es"), message(7, "a long text about rain and wind", start + 10 * 86400)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    raw = spark.readStream.text(str(tmp_path / "in"))
    posts = live.live_posts(raw, ["en"], ["wind"])
    seen = []
    live.ingest_stream(live.dedup_stream(posts), lambda batch, n: seen.extend(r.id for r in batch.collect()), str(tmp_path / "c1")).awaitTermination(60)
    assert len(seen) == 6 and len(set(seen)) == 6
    counted = live.tumbling_counts(posts.withColumn("topic", F.lit("t")))
    q = counted.writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counted").agg(F.sum("posts")).first()[0] == 6  # repeats included, the last open window not
