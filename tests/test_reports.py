"""What the queries don't show: options, authors, JSON columns, logs, histories, batches, and the streams end to end."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scores, text, urls
from tidewatch.operators import activity, alerts, entities, fingerprints, posts as P, trends
from tidewatch.operators.trends import TrendOptions
from tidewatch.sources import flatten, normalize
from tidewatch.operators.store import VersionedTables
from tidewatch.streaming import live
from tidewatch.streaming.ingest import archived, ingest_into, trend_series

NOW = 1_760_000_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_options_and_hosts(spark):
    options = F.create_map(*map(F.lit, ("a", " x, y,,z ", "n", "7.5", "bad", "many")))
    assert one(spark, normalize.text_option(options, "a")) == ["x", "y", "z"] and one(spark, normalize.text_option(options, "no", ["d"])) == ["d"]
    assert [one(spark, normalize.number_option(options, k, 3)) for k in ("n", "bad", "no")] == [7.5, 3.0, 3.0]
    got = [one(spark, urls.normalize_host(F.lit(h))) for h in (" https://www.Example.org/a?b ", "news.example.org:8080", "example.org.")]
    assert got == ["example.org", "news.example.org", "example.org"]


def test_words_without_topic():
    assert {"the", "porque", "https", "don't"} <= set(text.STOP_WORDS) and "press" not in text.STOP_WORDS


def test_authors_and_json(spark):
    handle = lambda h: one(spark, normalize.author_of(F.lit("web"), F.lit(h).cast("string")))
    assert tuple(handle("@Ana Díaz"))[:2] == ("web:ana-diaz", "Ana Díaz") and tuple(handle(None))[:2] == ("web:desconocido", "desconocido") and handle("@!!").id == "web:desconocido"
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, tags array<string>")
    coded = normalize.encode_json(rows, ["tags"])
    assert coded.first().tags == '["a","b"]' and normalize.decode_json(coded, {"tags": "array<string>"}).collect() == rows.collect()


def test_items_without_values(spark):
    raw = spark.createDataFrame([("web", "", "http://a.example/x/", None, " ", None, None, None, None, None, "o"), ("web", "7", None, "T", None, "en", "@a", None, None, [None, " "], "o")], "source string, external_id string, url string, title string, body string, lang string, author string, published_at timestamp, likes long, tags array<string>, origin string")
    got = {r.external_id: r for r in normalize.normalize_items(raw, NOW).collect()}
    assert got["7"].id == "web:7" and got["7"].tags == [] and got["7"].entities == [] and got["7"].published_at.timestamp() == NOW / 1000
    other = next(r for k, r in got.items() if k != "7")
    assert other.id == f"web:{other.external_id}" and (other.title, other.body, other.lang, other.simhash) == (None, None, "und", 0)
    assert normalize.normalize_items(raw.limit(0), NOW).count() == 0


def test_ranked_ids(spark):
    lists = spark.createDataFrame([(0, [5, 3, 9]), (1, [3, 8, 5, 1])], "rank int, ids array<long>")
    assert [r.id for r in flatten.merge_ranked_ids(lists, 4).collect()] == [5, 3, 9, 8]


def test_labels(spark):
    got = [one(spark, scores.age_label(F.lit(s))) for s in (30, 120, 7200)]
    assert [(r.value, r.unit) for r in got] == [(30, "s"), (2, "min"), (2, "h")]


def test_corpus_of_another_table(spark):
    docs = spark.createDataFrame([("a", "alpha alpha beta")], "id string, body string")
    corpus = spark.createDataFrame([("alpha", 1_000_000)], "token string, df long")
    assert {r.token: r.df for r in fingerprints.top_keywords(docs, corpus=corpus).collect()} == {"alpha": 1_000_000, "beta": 0}


def test_history_and_log(spark):
    seen = spark.createDataFrame([("a", 1, 10, 1.0, "quiet"), ("a", 2, 15, 1.5, "rising"), ("a", 3, 19, 9.0, "rising"), ("b", 1, 3, 1.0, "rising")], "topic string, at_ms long, score long, velocity double, state string")
    got = {(r.topic, r.at_ms): r.escalated for r in trends.history_of(seen).collect()}
    assert got == {("a", 1): False, ("a", 2): True, ("a", 3): False, ("b", 1): True}
    log = spark.createDataFrame([("x", 1, True)], "id string, created_ms long, read boolean")
    new = spark.createDataFrame([("x", 5, False), ("y", 2, False), ("z", 2, False)], log.schema)
    got = alerts.alert_log(log, new, spark.createDataFrame([("z",)], "id string"), 2).collect()
    assert [(r.id, r.created_ms, r.read) for r in got] == [("y", 2, False), ("z", 2, True)]


def test_words_in_trends(spark):
    rows = spark.createDataFrame([("a", "Big News", ["rust"], ["spark"]), ("b", "Other", ["News"], [])], "topic string, title string, keywords array<string>, entities array<string>")
    found = lambda words: {r.topic for r in trends.matching(rows, words).collect()}
    assert found(" NEWS ") == {"a", "b"} and found("rust") == {"a"} and found("spark") == found("n") == found("  ") == set()


def test_batches_of_texts(spark):
    texts = spark.createDataFrame([(f"t{i}",) for i in range(3000)], "text string")
    sizes = entities.translation_batches(texts, 4).groupBy("part", "batch").count()
    assert sizes.agg(F.max("count")).first()[0] == 4 and sizes.agg(F.sum("count")).first()[0] == 3000


def test_rules_on_entities_and_texts(spark):
    post = lambda i, topic, title: (i, topic, title, None, ["tag"])
    posts = spark.createDataFrame([post(1, "t1", "A Needle here"), post(2, "t2", None)], "id long, topic string, title string, body string, tags array<string>")
    trend = "topic string, title string, keywords array<string>, entities array<string>, score long, state string, reason string, velocity double, growth double, volume long, coverage long, sources array<struct<source:string>>"
    rows = spark.createDataFrame([("t1", "One", ["k"], ["ent"], 1, "quiet", "sustained", 1.0, 5.0, 9, 2, [("s",)]), ("t2", "Two", [], [], 1, "quiet", "sustained", 1.0, 5.0, 9, 2, [("s",)])], trend)
    rules = spark.createDataFrame([("text", "keyword", True, "needle", None, None, None, None), ("tag", "keyword", True, "tag", None, None, None, None), ("ent", "watched_entity", True, "ENT", None, None, None, None), ("name", "watched_entity", True, "one", None, None, None, None), ("blank", "keyword", True, "", None, None, None, None)], alerts.RULE)
    got = {(r.rule_id, r.topic) for r in alerts.evaluate_rules(rules, rows, NOW, None, posts).collect()}
    assert got == {("text", "t1"), ("tag", "t1"), ("tag", "t2"), ("ent", "t1")}
    assert {r.rule_id for r in alerts.evaluate_rules(rules, rows, NOW).collect()} == {"ent"}
    kinds = [(k, k, k != "off", "  " if k == "keyword" else None, 1.0, None, None, None) for k in ("multi_source", "global_breaking", "topic_surge", "project_velocity", "unheard_of", "keyword")] + [("null", None, True, None, 9.0, None, None, None), ("far", "project_velocity", True, None, None, 1, ["x"], None)]
    some = rows.withColumn("state", F.when(F.col("topic") == "t1", "rising").otherwise("breaking")).withColumn("coverage", F.when(F.col("topic") == "t1", 3).otherwise(2))
    got = {(r.rule_id, r.topic) for r in alerts.evaluate_rules(spark.createDataFrame(kinds, alerts.RULE), some, NOW, None, posts).collect()}
    assert got == {("multi_source", "t1"), ("global_breaking", "t2"), ("topic_surge", "t1"), ("topic_surge", "t2"), ("project_velocity", "t1"), ("project_velocity", "t2"), ("unheard_of", "t1"), ("unheard_of", "t2"), ("keyword", "t1"), ("keyword", "t2")}


def test_needles_against_all_pairs(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcü \n") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "𝒳y"]
    needles = ["".join(rng.choice("abcü ") for _ in range(rng.randint(0, 6))) for _ in range(150)] + ["𝒳", "zzz", "ab"]
    frames = spark.createDataFrame(list(enumerate(texts)), "key long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    want = {(n, k) for n in needles for k, t in enumerate(texts) if n and t and n in t}
    assert {tuple(r) for r in alerts.needles_in(*frames).collect()} == want
    assert alerts.needles_in(frames[0], frames[1].limit(0)).count() == 0 and alerts.needles_in(frames[0].limit(0), frames[1]).count() == 0


def test_very_many_rules(spark, tmp_path):
    made = spark.range(120_000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("keyword").alias("kind"), F.lit(True).alias("enabled"), F.concat(F.lit("needle number "), F.col("id").cast("string"), F.lit("!")).alias("query"), F.lit(None).cast("double").alias("min_growth"), F.lit(None).cast("int").alias("min_sources"), F.lit(None).cast("array<string>").alias("sources"), F.lit(None).cast("long").alias("cooldown_ms"))
    trend = "topic string, title string, keywords array<string>, entities array<string>, score long, state string, reason string, velocity double, growth double, volume long, coverage long, sources array<struct<source:string>>"
    rows = spark.createDataFrame([(f"t{i}", f"Title {i}", [], [], 1, "quiet", "sustained", 1.0, 5.0, 9, 2, [("s",)]) for i in range(50)], trend)
    posts = spark.range(500).select((F.concat(F.lit("t"), F.col("id") % 50)).alias("topic"), F.concat(F.lit("A NEEDLE number "), F.col("id") * 200, F.lit("! is here")).alias("title"))
    made.write.parquet(str(tmp_path / "rules"))
    events = alerts.evaluate_rules(spark.read.parquet(str(tmp_path / "rules")), rows, NOW, None, posts)
    assert events.count() == 500
    plan = events._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_search_index_of_files(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Árbol grande"), ("b", "arbol"), ("c", None)], "id string, body string").withColumn("published_at", F.timestamp_millis(F.lit(NOW)))
    P.search_index(docs, F.col("body")).write.partitionBy("head").parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert [r.id for r in P.search_in(index, "ARBOL grande").collect()] == ["a"] and P.search_in(index, " x ").count() == 0
    assert "PartitionFilters: [head" in P.search_in(index, "arbol")._jdf.queryExecution().toString().replace("isnotnull(head", "head")


@pytest.fixture
def stream(spark, tmp_path):
    """A file stream of posts; each call writes another file."""
    folder = tmp_path / "in"
    folder.mkdir()
    names = []

    def add(rows):
        names.append(1)
        (folder / f"{len(names)}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def read(schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))

    return add, read


def run(frame, name, mode):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return frame.sparkSession.table(name).collect()


def test_windows_sessions_and_maxima(spark, stream):
    add, read = stream
    at = lambda minute: f"2024-01-01T0{minute // 60}:{minute % 60:02d}:00Z"
    add([{"id": "a", "topic": "t", "source": "s", "published_at": at(m), "likes": m} for m in (0, 1, 30)])
    add([{"id": "a", "topic": "t", "source": "s", "published_at": at(100), "likes": 3}])
    schema = "id string, topic string, source string, published_at timestamp, likes long"
    rates = run(live.rolling_rates(read(schema), "1 hour", "30 minutes", "1 minute"), "rates_t", "update")
    assert max(r.posts for r in rates) == 3
    spans = run(live.topic_sessions(read(schema), "20 minutes", "1 minute"), "spans_t", "append")
    assert sorted((r.posts, (r.end - r.start).seconds // 60) for r in spans) == [(1, 20), (2, 21)]
    most = run(live.metric_maxima(read(schema), ["likes"]), "most_t", "complete")
    assert [(r.id, r.likes) for r in most] == [("a", 30)]
    named = live.with_handles(spark.createDataFrame([("d1",), ("d2",)], "author string"), spark.createDataFrame([("d1", "ana")], "author string, handle string"))
    assert sorted(r.handle for r in named.collect()) == ["ana", "d2"]


def test_buffer_of_a_batch(spark, stream, tmp_path):
    add, read = stream
    add([{"id": str(i), "published_at": f"2024-01-01T00:{i:02d}:00Z"} for i in range(10)])
    told, kept = [], []
    take = live.newest_of_batch(4, lambda n, dropped: told.append(dropped), lambda batch, n: kept.extend(r.id for r in batch.collect()))
    assert live.ingest_stream(read("id string, published_at timestamp"), take, str(tmp_path / "c")).awaitTermination(120)
    assert told == [6] and sorted(kept) == ["6", "7", "8", "9"]


def test_ingest_end_to_end(spark, stream, tmp_path):
    add, read = stream
    post = lambda i, words: {"source": f"s{i % 4}", "external_id": str(i), "url": f"http://x.example/{i}", "title": words, "published_at": "2025-10-09T08:5%d:00Z" % (i % 10), "origin": "t", "likes": i}
    quake = "earthquake shakes coastal harbour city overnight rescue"
    add([post(i, quake) for i in range(6)] + [post(9, "football league final tickets announced")])
    add([post(i, quake) for i in (2, 3, 12, 13)])
    rules = spark.createDataFrame([("quake", "keyword", True, "harbour", -5.0, 1, None, 60_000_000)], alerts.RULE)
    now = 1_760_000_400_000
    told = []
    ingest = ingest_into(str(tmp_path / "store"), lambda: now, rules, TrendOptions(), listener=lambda t, e: told.append((t.count(), e.count())))
    raw = read(flatten.RAW)
    assert live.ingest_stream(raw, ingest, str(tmp_path / "c")).awaitTermination(300)
    store = VersionedTables(spark, str(tmp_path / "store"))
    assert (store.read("posts", 0).count(), store.read("posts", 1).count()) == (7, 9) and store.versions() == [0, 1]
    by_topic = {r.topic: r["count"] for r in archived(store, now).groupBy("topic").count().collect()}
    assert sorted(by_topic.values()) == [1, 8] and store.read("topics").count() == 2
    best = store.read("trends").orderBy(F.desc("volume")).first()
    assert best.title == quake and best.volume == 8 and best.coverage == 4
    assert (store.read("events", 0).count(), store.read("events", 1).count()) == (1, 1) and told == [(2, 1), (2, 0)]
    assert [(r.fetched, r.inserted, r.duplicates) for r in store.read("reports").orderBy("inserted").collect()] == [(4, 2, 2), (7, 7, 0)]
    assert trend_series(store).count() == 2


def test_activity_by_ingest_time(spark):
    none = spark.createDataFrame([], "source string, topic string, published_at timestamp, ingested_at timestamp, body string")
    some = spark.createDataFrame([("a", "t", NOW - 60_000, "harbour news"), ("b", "t", NOW - 7_200_000, "harbour")], "source string, topic string, ms long, body string").withColumn("published_at", F.timestamp_millis("ms")).withColumn("ingested_at", F.timestamp_millis(F.col("ms") + 20_000))
    trend = spark.createDataFrame([], "topic string, title string, state string, score long, velocity double, coverage long, volume long")
    config = lambda *rows: spark.createDataFrame(list(rows), "source string, enabled boolean, last_error string")
    fine = config(("a", True, None), ("b", False, "off"))

    def shot(posts, configs=fine, **more):
        return activity.activity_snapshot(posts, F.col("body"), trend, configs, NOW, **more).first()

    for age, level, seconds in ((20_000, "live", None), (300_000, "recent", None), (1_800_000, "stale", 1800), (7_200_000, "quiet", None)):
        one = shot(some, last_ingest_ms=NOW - age)
        assert (one.level, one.note.code, one.note.seconds) == (level, level, seconds)
    one = shot(some, alerts=3)
    assert (one.last_ingest_ms, one.level, one.totals.sources, one.totals.alerts, one.first_error) == (NOW - 40_000, "live", 1, 3, None)
    assert [(k.word, k.posts, k.sources, k.topics) for k in one.keywords] == [("harbour", 2, 2, 1), ("news", 1, 1, 1)]
    one = shot(none)
    assert (one.level, one.note.code, one.last_ingest_ms, one.keywords, one.highlights) == ("quiet", "no_data", None, [], [])
    assert shot(none, last_ingest_ms=NOW).note.code == "live"
    one = shot(some, config(("b", True, "HTTP 403"), ("a", True, "HTTP 503")))
    assert (one.note.code, one.note.sources, one.first_error) == ("all_sources_failed", 2, "HTTP 503")
    assert shot(none, config(("x", True, "E"), ("y", True, None))).first_error == "E" and shot(some, fine.limit(0)).note.code == "live"


def test_members_of_lists(spark):
    posts = spark.createDataFrame([(1, "web", "@Ana", "web:7", ["ai"]), (2, "hn", "ana", None, None), (3, "hn", None, "hn:x", ["AI", "ai"])], "id long, source string, handle string, author_id string, entities array<string>")
    of = lambda *members: sorted(r.id for r in P.posts_of_list(posts, spark.createDataFrame([("l", m) for m in members], "list string, member string")).collect())
    assert of("ANA") == [1, 2] and of("hn:@ana") == of("hn:ana", "HN:Ana") == [2] and of("web:7") == [1] and of("ai", "@ana") == [1, 2, 3] and of("hn:x", "AI") == [1, 3] and of("nobody", None) == []
    bare = posts.select("id", "handle")
    assert [r.id for r in P.posts_of_list(bare, spark.createDataFrame([("l", "@ana")], "list string, member string")).orderBy("id").collect()] == [1, 2]


def test_limit_of_a_feed(spark):
    item = lambda i: f"<item><title>T{i}</title><link>http://a.example/{i}</link></item>"
    rss = f"<rss><channel><title>A</title>{''.join(map(item, range(30)))}</channel></rss>"
    one = f"<rss><channel>{item(99)}<item><title>none</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><id>e1</id><link rel="alternate" href="http://b.example/1"/><updated>2025-01-01T00:00:00Z</updated></entry></feed>'
    docs = spark.createDataFrame([("f1", rss), ("f2", one), ("f3", atom), ("f4", "no feed"), ("f5", "<a/>"), ("f6", None)], "feed_url string, value string")
    got = flatten.CONNECTORS["feeds"](docs).select("origin", "title", "published_at").collect()
    assert [r.title for r in got if r.origin == "f1"] == [f"T{i}" for i in range(25)]
    assert sorted((r.origin, r.title) for r in got if r.origin != "f1") == [("f2", "T99"), ("f3", "E")]
    assert {r.published_at for r in got if r.origin != "f3"} == {None} and flatten.feeds(docs, most=2).count() == 4
