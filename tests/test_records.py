"""One bad record among good ones, at each step, is told apart and keeps no other back."""

import json

import pytest

from tidewatch.operators import alerts
from tidewatch.operators.store import VersionedTables
from tidewatch.sources import flatten, records
from tidewatch.streaming import live
from tidewatch.streaming.ingest import archived, ingest_into

NOW = 1_760_000_400_000
STORY = {"id": 1, "type": "story", "by": "u", "title": "T", "time": 1760000000, "score": 3}
POST = {"uri": "at://did/app.post/k1", "author": {"did": "did"}, "record": {"text": "hello", "createdAt": "2025-01-01T00:00:00Z"}, "likeCount": 4}
CHILD = {"data": {"id": "r1", "title": "A", "permalink": "/r/x/1", "subreddit": "x", "created_utc": 1760000000.0}}
REPO = {"id": 5, "full_name": "o/r", "html_url": "https://g.example/o/r", "created_at": "2025-01-01T00:00:00Z"}
CASES = {
    "hackernews": ([STORY, {**STORY, "id": 2, "score": "many"}, {**STORY, "id": 3, "time": 2**62}, "text"], {"1", "3"}, [records.NO_FIT, records.NO_JSON, records.NO_JSON]),
    "bluesky": ([{"posts": [POST, {**POST, "uri": "at://x/y/k2", "likeCount": {"n": 1}}, None, 7, {**POST, "uri": "at://x/y/k3"}]}, {"posts": []}, {"posts": None}], {"at://did/app.post/k1", "at://x/y/k3"}, [records.NO_FIT, records.NO_JSON, records.NO_JSON, records.NO_JSON]),
    "reddit": ([{"data": {"children": [CHILD, {"data": {**CHILD["data"], "id": "r2", "score": [1]}}, {"data": {**CHILD["data"], "id": "r3", "created_utc": 1e300}}]}}], {"r1", "r3"}, [records.NO_FIT, records.NO_JSON]),
    "github": ([{"items": [REPO, {**REPO, "id": 6, "topics": 9}]}, {"items": 3}], {"5"}, [records.NO_FIT, records.NO_FIT, records.NO_JSON]),
    "mastodon": ([{"id": "m1", "content": "hi"}, {"id": "m2", "account": "a"}], {"m1"}, [records.NO_FIT, records.NO_JSON]),
}


@pytest.mark.parametrize("source", CASES)
def test_records_of_a_source(spark, tmp_path, source):
    rows, good, wrong = CASES[source]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n\n")
    got = records.read_posts(spark, source, str(tmp_path)).collect()
    assert {r.external_id for r in got if r.message is None} == good
    assert sorted(r.message for r in got if r.message) == sorted(wrong)
    assert all(r.record and r.source == source for r in got if r.message) and "{broken" in {r.record for r in got}


def test_a_batch_with_bad_records_stores_the_others(spark, tmp_path):
    (tmp_path / "in").mkdir()
    odd = [{**STORY, "id": i, "url": u, "title": t} for i, u, t in ((10, "http://[bad", "x"), (11, "%%%", None), (12, "", " "), (13, "http://a b/%zz?q=%", "\u0000"))]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, [STORY, {**STORY, "id": None, "url": None}, {**STORY, "id": 2, "score": "many"}, {**STORY, "id": 3, "time": 2**62}, *odd])) + "\n{broken\n")
    folder = str(tmp_path / "s")
    stream = records.read_posts(spark, "hackernews", str(tmp_path / "in"), stream=True)
    assert live.ingest_stream(stream, ingest_into(folder, lambda: NOW, alerts.default_rules(spark), parts=2), str(tmp_path / "c")).awaitTermination(300)
    store = VersionedTables(spark, folder)
    assert {r.external_id for r in archived(store, NOW).collect()} == {"1", "3", "10", "11", "12", "13"}
    assert {(r.source, r.message) for r in store.read("errors").collect()} == {("hackernews", m) for m in (records.NO_FIT, records.NO_JSON, records.NO_IDENTITY)}
    assert [(r.fetched, r.inserted, r.duplicates, r.errors) for r in store.read("reports").collect()] == [(9, 6, 0, 3)]


def test_only_bad_records_and_none(spark):
    raw = spark.createDataFrame([(None, "1"), ("s", " "), ("s", "2")], "source string, external_id string").withColumns({c: __import__("pyspark").sql.functions.lit(None).cast(k) for c, k in (x.strip().split(" ", 1) for x in flatten.RAW.split(", ")) if c not in ("source", "external_id")})
    good, bad = records.told_apart(raw)
    assert [r.external_id for r in good.collect()] == ["2"] and sorted(r.message for r in bad.collect()) == sorted([records.NO_SOURCE, records.NO_IDENTITY])
    good, bad = records.told_apart(raw.limit(0))
    assert good.count() == bad.count() == 0
