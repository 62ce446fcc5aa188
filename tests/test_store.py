"""Versioned tables, running counts and the ingest: parts that stay, batches that are run again or die, metrics that rise."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts, running, topics, trends
from tidewatch.operators.posts import upsert_posts
from tidewatch.operators.store import VersionedTables, part_of
from tidewatch.operators.trends import TrendOptions
from tidewatch.sources import flatten
from tidewatch.streaming.ingest import archived, ingest_into

NOW = 1_760_000_400_000


def files(folder):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def put(store, number, rows, commit=True):
    batch = store.batch(number)
    batch.upsert("posts", rows, upsert_posts, parts=8)
    batch.replace("note", rows.sparkSession.range(number + 1))
    if commit:
        batch.commit()


def test_touched_parts_alone_are_rewritten(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"))
    assert store.read("posts") is None and store.tables() == {}
    posts = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("b").alias("body"), F.lit(5).alias("likes"))
    put(store, 0, posts)
    before = files(tmp_path / "s" / "posts")
    put(store, 1, posts.filter("id IN ('7', '8')").withColumn("likes", F.when(F.col("id") == "7", 9).otherwise(1)).union(spark.createDataFrame([("new", "c", 1)], "id string, body string, likes int")))
    after = files(tmp_path / "s" / "posts")
    assert before.items() <= after.items()
    likes = {r.id: r.likes for r in store.read("posts").collect()}
    assert len(likes) == 201 and (likes["7"], likes["8"], likes["new"]) == (9, 5, 1)
    touched = {r.p for r in spark.createDataFrame([("7",), ("8",), ("new",)], "id string").select(part_of("id", 8).alias("p")).collect()}
    assert {int(f.split("part=")[1].split("/")[0]) for f in after.keys() - before.keys()} == touched
    assert {r.id: r.likes for r in store.read("posts", 0).collect()}["7"] == 5
    store.vacuum(1)
    assert store.versions() == [1] and store.read("posts").count() == 201


def test_a_batch_that_dies_or_is_run_again(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"))
    posts = spark.createDataFrame([("a", "x", 1)], "id string, body string, likes int")
    put(store, 0, posts)
    put(store, 1, posts.withColumn("likes", F.lit(8)), commit=False)  # between its tables and the marker
    assert store.read("posts").first().likes == 1 and store.read("note").count() == 1
    put(store, 1, posts.withColumn("likes", F.lit(3)))
    assert store.read("posts").first().likes == 3 and store.read("note").count() == 2
    again = store.batch(1)
    assert again.done and again.before == store.tables(0)


@pytest.mark.parametrize("seed", [1, 2])
def test_cells_of_any_split_score_like_posts(spark, seed):
    rng = random.Random(seed)
    options = TrendOptions()
    now = running.whole(NOW, 1000)
    ages = [0, -500, -1000, 120_000, 119_999, 1_800_000, 1_800_001, 1_799_999, 21_600_000, 21_600_001, 90_000_000]
    rows = [(f"t{rng.randint(0, 3)}", f"s{rng.randint(0, 4)}", now - (rng.choice(ages) if rng.random() < 0.4 else rng.randint(0, 25_000_000)), rng.randint(0, 50)) for _ in range(600)]
    posts = spark.createDataFrame(rows, "topic string, source string, ms long, likes long").withColumn("published_at", F.timestamp_millis("ms")).withColumn("batch", F.lit(0)).cache()
    want = {r.topic: r for r in trends.score_topics(posts, now, options).collect()}
    cells, parts = None, posts.randomSplit([0.2, 0.5, 0.3], seed)
    for part in parts:
        fresh = running.count_cells(part, 1000)
        cells = running.retire_cells(fresh if cells is None else running.merge_cells(cells, fresh), now, options)
    got = {r.topic: r for r in running.score_cells(cells, now, options).collect()}
    assert {k: r.asDict(True) for k, r in got.items()} == {k: r.asDict(True) for k, r in want.items()}
    assert cells.filter("at_ms IS NULL").groupBy("topic", "source").count().filter("count > 1").isEmpty()
    assert running.score_cells(cells.limit(0), now, options).count() == 0


def test_states_of_any_split_roll_up_like_posts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"t{rng.randint(0, 2)}", f"p{i}", NOW - rng.randint(0, 1000), f"s{rng.randint(0, 2)}", rng.sample(words, 4), rng.sample(words, rng.randint(0, 3)), rng.getrandbits(63)) for i in range(120)]
    members = spark.createDataFrame(rows, "topic string, id string, ms long, source string, keywords array<string>, entities array<string>, simhash long").withColumn("published_at", F.timestamp_millis("ms"))
    a, b, c = members.randomSplit([0.3, 0.3, 0.4], 5)
    got = topics.topics_of(topics.merge_states(topics.topic_states(a), topics.merge_states(topics.topic_states(b), topics.topic_states(c))))
    want = topics.roll_up(members)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def raw(spark, rows):
    return spark.read.schema(flatten.RAW).json(spark.sparkContext.parallelize([__import__("json").dumps(r) for r in rows]))


def post(i, words, likes, minute=50):
    return {"source": f"s{i % 4}", "external_id": str(i), "url": f"http://x.example/{i}", "title": words, "published_at": f"2025-10-09T08:{minute:02d}:00Z", "origin": "t", "likes": likes}


def test_ingest_refreshes_merges_and_retires(spark, tmp_path):
    quake, ball = "earthquake shakes coastal harbour city overnight rescue", "football league final tickets announced"
    clock = [NOW]
    ingest = ingest_into(str(tmp_path / "s"), lambda: clock[0], alerts.default_rules(spark), TrendOptions(), parts=4)
    ingest(raw(spark, [post(i, quake, 1) for i in range(4)] + [post(0, quake, 7), post(9, ball, 2)]), 0)
    store = VersionedTables(spark, str(tmp_path / "s"))
    first = {r.external_id: (r.likes, r.topic) for r in archived(store, NOW).collect()}
    assert len(first) == 5 and first["0"][0] == 7 and len({t for _, t in first.values()}) == 2

    clock[0] += 60_000
    ingest(raw(spark, [post(1, "another title", 99), post(2, quake, 0), post(20, quake, 3, 55)]), 1)
    second = {r.external_id: (r.likes, r.topic, r.title) for r in archived(store, clock[0]).collect()}
    assert second["1"] == (99, first["1"][1], quake) and second["2"][0] == 1 and second["20"][1] == first["0"][1]
    stored = archived(store, clock[0])
    want = {r.topic: r for r in trends.score_topics(stored, running.whole(clock[0], 1000)).collect()}
    for r in store.read("trends").collect():
        assert (r.score, r.volume, r.engagement, r.sparkline) == (want[r.topic].score, want[r.topic].volume, want[r.topic].engagement, want[r.topic].sparkline)
    ingest(raw(spark, [post(1, quake, 500)]), 1)  # a batch that is committed and comes again
    assert {r.external_id: r.likes for r in archived(store, clock[0]).collect()}["1"] == 99

    clock[0] += 31 * 86_400_000
    ingest(raw(spark, [{**post(50, "new words about nothing known", 1), "published_at": "2025-11-09T08:50:00Z"}]), 2)
    assert [r.external_id for r in archived(store, clock[0]).collect()] == ["50"]
    assert store.read("trends").count() == store.read("topics").count() == 1
