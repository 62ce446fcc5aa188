"""Landed logs: lines in blocks of any size, offsets that streams go on from, and what listeners hear."""

import json

import pytest

from tidewatch.sources.landed import Block, _Growing, _Log, read_log, logged_posts
from tidewatch.streaming.updates import listening


def put(root, source, segment, data, mode="wb"):
    (root / source).mkdir(exist_ok=True)
    with open(root / source / segment, mode) as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def item(i):
    return json.dumps({"id": i, "type": "story", "by": f"u{i}", "title": f"title {i} ä", "time": 1_700_000_000 + i, "score": i})


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_every_line_is_read_once_whatever_the_blocks(tmp_path, block):
    text = "a\n\nbbbb\n\r\nccc" + "x" * 50 + "\näö\n  \nend without newline"
    put(tmp_path, "s", "1", text)
    put(tmp_path, "s", "_not", "no\n")
    log = _Log({"path": str(tmp_path), "blockBytes": str(block)})
    (name, size), *more = log.segments()["s"]
    assert (name, more) == ("1", [])
    rows = [r for b in log.blocks("s", name, 0, size) for batch in log.read(b) for r in batch.to_pylist()]
    data = text.encode()
    assert [r["value"] for r in rows] == [x for x in text.replace("\r", "").split("\n") if x.strip()]
    assert all(data[r["start"] :].decode().startswith(r["value"]) and (r["start"] == 0 or data[r["start"] - 1 : r["start"]] == b"\n") for r in rows)


def test_offsets_are_a_segment_and_a_byte(tmp_path):
    reader = _Growing({"path": str(tmp_path)})
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    put(tmp_path, "s", "1", "one\ntw")
    assert reader.latestOffset() == {"s": ["1", 4]}
    put(tmp_path, "s", "1", "o\nthree", "ab")
    put(tmp_path, "s", "2", "four\nfi")
    put(tmp_path, "t", "9", "nothing yet")
    end = reader.latestOffset()
    assert end == {"s": ["2", 5], "t": ["9", 0]}
    # What a finished segment ends with is a line even if its end is missing.
    assert reader.partitions({"s": ["1", 4]}, end) == [Block("s", "1", 4, 4, 13), Block("s", "2", 0, 0, 5)]
    got = [r["value"] for b in reader.partitions({"s": ["1", 4]}, end) for batch in reader.read(b) for r in batch.to_pylist()]
    assert got == ["two", "three", "four"]
    assert _Growing({"path": str(tmp_path)}).latestOffset() == end
    with pytest.raises(ValueError, match="gone"):
        reader.partitions({}, {"s": ["7", 1]})
    with pytest.raises(ValueError, match="path"):
        _Growing({})


def test_batch_of_a_log(spark, tmp_path):
    put(tmp_path, "hackernews", "1", "".join(item(i) + "\n" for i in range(40)) + "{bad\n")
    put(tmp_path, "hackernews", "2", b'{"id": 99, "type": "job", "title": "\xff"}')
    put(tmp_path, "other", "1", "x\n")
    (tmp_path / "empty").mkdir()
    posts = logged_posts(spark, str(tmp_path), "hackernews", block=256).collect()
    assert sorted(int(r.external_id) for r in posts if r.record is None) == [*range(40), 99]
    assert [r.record for r in posts if r.record] == ["{bad"] and {r.title for r in posts if r.external_id == "3"} == {"title 3 ä"}
    assert read_log(spark, str(tmp_path)).groupBy("source").count().count() == 2
    assert read_log(spark, str(tmp_path), "empty").count() == 0 and read_log(spark, str(tmp_path / "none")).count() == 0
    assert read_log(spark, str(tmp_path), "hackernews", block=256).rdd.getNumPartitions() > 10


def test_a_stream_goes_on_from_its_offset(spark, tmp_path):
    log, checkpoint, seen = tmp_path / "log", str(tmp_path / "c"), []
    log.mkdir()

    def run():
        posts = logged_posts(spark, str(log), "hackernews", stream=True)
        query = posts.writeStream.queryName("logged").foreachBatch(lambda b, n: seen.append(sorted(int(r.external_id) for r in b.collect()))).option("checkpointLocation", checkpoint)
        assert query.trigger(availableNow=True).start().awaitTermination(180)
        return [i for batch in seen for i in batch]

    with listening(spark) as updates:
        heard, failing = [], lambda update: 1 / 0
        updates.subscribe(failing)
        end = updates.subscribe(lambda update: heard.append((update["event"], update["name"], update["batch"])))
        put(log, "hackernews", "1", item(1) + "\n" + item(2) + "\n" + item(3)[:10])
        assert run() == [1, 2]
        put(log, "hackernews", "1", item(3)[10:] + "\n", "ab")
        put(log, "hackernews", "2", item(4) + "\n")
        assert run() == [1, 2, 3, 4]
        assert run() == [1, 2, 3, 4]
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        end()
        assert ("started", "logged", None) in heard and ("progress", "logged", 0) in heard and ("progress", "logged", 1) in heard and any(e == "terminated" for e, _, _ in heard)
        assert updates.failures and {r.event for r in updates.frame(spark).collect()} >= {"started", "progress", "terminated"}
