"""Topics that posts open, known topics, snapshots and watch terms on small cases."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewatch.functions.text import detect_source_language
from tidewatch.operators import outcomes, topics

NOW = datetime(2025, 10, 9, 8, 0, tzinfo=timezone.utc)
TEXTS = {
    "a1": "solar panel factory opens valley", "a2": "solar panel factory opens valley today", "b1": "football final penalty drama", "c1": None,
    "b2": "football final penalty drama again", "a3": "solar panel factory opens valley",
}


def posts(spark):
    rows = [(k, NOW + timedelta(minutes=i), f"s{i % 2}", t, []) for i, (k, t) in enumerate(TEXTS.items())]
    return spark.createDataFrame(rows, "id string, published_at timestamp, source string, body string, entities array<string>")


def test_topics_are_opened_and_rolled_up(spark):
    made = topics.features(posts(spark))
    of = {r.id: r.topic for r in topics.open_topics(made).collect()}
    assert of == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "c1": "c1"}
    members = made.join(spark.createDataFrame(list(of.items()), "id string, topic string"), "id")
    rows = {r.topic: r for r in topics.roll_up(members.union(members.filter("id = 'a2'"))).collect()}
    assert (rows["a1"].posts, rows["a1"].corroborations, rows["a1"].sources) == (3, 1, ["s0", "s1"])
    assert set(TEXTS["a1"].split()) <= set(rows["a1"].keywords) and rows["c1"].keywords == []


def test_posts_with_equal_entities_share_a_topic(spark):
    rows = [("x", NOW, "s0", "glacier melts quickly", ["alps"]), ("y", NOW + timedelta(minutes=1), "s1", "gletscher schmilzt schnell", ["alps"]), ("z", NOW + timedelta(hours=9), "s1", "gletscher schmilzt schnell", ["alps"])]
    made = topics.features(spark.createDataFrame(rows, "id string, published_at timestamp, source string, body string, entities array<string>"))
    hashes = {r.id: r.simhash for r in made.collect()}
    alike = 1 - bin((hashes["x"] ^ hashes["y"]) & (2**64 - 1)).count("1") / 64
    of = {r.id: r.topic for r in topics.open_topics(made).collect()}
    assert of["x"] == "x" and of["y"] == ("x" if 0.35 + 0.25 * alike >= 0.45 else "y") and of["z"] != "x"
    assert topics.open_topics(made.limit(0)).count() == 0


def test_twins_merge_over_links(spark):
    kw = ["x", "y", "z"]
    rows = [("t1", kw, ["e"], 5), ("t2", kw[::-1], ["e"], 5), ("t3", kw, [], 5), ("t4", ["q"], ["e"], 5), ("t5", [], [], 5)]
    made = spark.createDataFrame(rows, "topic string, keywords array<string>, entities array<string>, centroid long")
    assert {tuple(r) for r in topics.merge_topics(made).collect()} == {("t1", "t1"), ("t2", "t1"), ("t3", "t1"), ("t4", "t4"), ("t5", "t5")}
    assert topics.merge_topics(made.limit(0)).count() == 0


def test_known_posts_keep_living_topics(spark):
    assigned = spark.createDataFrame([("a1", "t1"), ("a2", "gone")], "id string, topic string")
    known, new = topics.keep_known(posts(spark), assigned, spark.createDataFrame([("t1",)], "topic string"))
    assert [tuple(r) for r in known.collect()] == [("a1", "t1")] and {r.id for r in new.collect()} == set(TEXTS) - {"a1"}
    idle = spark.createDataFrame([("t1", NOW), ("t2", NOW - timedelta(hours=7))], "topic string, last_seen timestamp")
    assert [r.topic for r in topics.active_topics(idle, int(NOW.timestamp() * 1000)).collect()] == ["t1"]


def test_watch_terms(spark):
    queries = spark.createDataFrame([("Rust, go, Spark ",), (None,)], "query string")
    watchlist = spark.createDataFrame([("open-data",), ("ai",)], "slug string")
    entities = spark.createDataFrame([("AI", "ai", True), ("Off", "off", False)], "name string, slug string, watch boolean")
    assert [r.term for r in outcomes.watch_terms(queries, watchlist, entities).collect()] == ["rust", "spark", "open data", "ai"]


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"posts": posts(spark), "none": spark.range(0)}
    outcomes.write_snapshot(tables, str(tmp_path), 3)
    back = outcomes.read_snapshot(spark, str(tmp_path), 3, list(tables))
    assert sorted(back["posts"].collect()) == sorted(tables["posts"].collect()) and {tuple(r) for r in outcomes.row_counts(back).collect()} == {("posts", 6), ("none", 0)}


def test_source_language(spark):
    want = {"¿Dónde está el niño que vino?": "es", "The cat and the dog": "en", "Der Hund ist nicht groß": "de", "hola": None, "xyzzy plugh quux": None, "": None, None: None}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", detect_source_language(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in got} == want
