"""Late rows: a side table, and a merge that corrects closed windows once, whatever is run again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.store import Batch, VersionedTables
from tidewatch.streaming import late, live

HOUR, SCHEMA = 3_600_000, "id string, topic string, source string, published_at timestamp"


def rows(spark, *made):
    """id, minutes after noon."""
    return spark.createDataFrame([(i, "t", "s", m) for i, m in made], "id string, topic string, source string, m long").select("id", "topic", "source", F.timestamp_millis(F.col("m") * 60_000 + 12 * HOUR).alias("published_at"))


def seen(spark, folder):
    return {(r.start_ms // HOUR): (r.posts, r.late_posts, r.closed) for r in late.window_counts(spark, folder, HOUR).collect()}


def test_a_late_row_changes_its_window_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "w")
    take = late.count_windows(folder, HOUR, HOUR, parts=4)
    assert late.correct_closed(spark, folder) == 0 and late.window_counts(spark, folder).count() == 0
    take(rows(spark, ("a", 5), ("a", 5), ("b", 50), ("n", None), ("c", 200)), 0)
    assert seen(spark, folder) == {12: (2, 0, True), 15: (1, 0, False)}
    batch = rows(spark, ("d", 10), ("a", 5), ("e", 150), ("f", 201))  # d is late, a comes again, e is in an open window
    whole = Batch.commit
    monkeypatch.setattr(Batch, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        take(batch, 1)
    monkeypatch.setattr(Batch, "commit", whole)
    assert seen(spark, folder) == {12: (2, 0, True), 15: (1, 0, False)} and late.correct_closed(spark, folder) == 0
    take(batch, 1)
    take(batch, 1)
    assert seen(spark, folder) == {12: (2, 0, True), 14: (1, 0, False), 15: (2, 0, False)}
    assert [(r.id, r.behind_ms) for r in VersionedTables(spark, folder).read("late").collect()] == [("d", 130 * 60_000)]

    monkeypatch.setattr(Batch, "commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        late.correct_closed(spark, folder)
    monkeypatch.setattr(Batch, "commit", whole)
    assert seen(spark, folder)[12] == (2, 0, True)
    assert late.correct_closed(spark, folder) == 1 and late.correct_closed(spark, folder) == 0
    assert seen(spark, folder)[12] == (3, 1, True)
    take(rows(spark, ("d", 10), ("g", 20)), 2)  # d once more
    assert late.correct_closed(spark, folder) == 1 and seen(spark, folder)[12] == (4, 2, True)
    take(rows(spark), 3)
    assert late.correct_closed(spark, folder) == 0 and seen(spark, folder)[12] == (4, 2, True)


def test_streamed_windows_end_as_if_nothing_were_late(spark, tmp_path):
    posts = [(f"p{i}", (i * 37) % 600) for i in range(60)]
    for k in range(4):
        rows(spark, *posts[15 * k : 15 * k + 15], posts[k]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "w")
    assert live.ingest_stream(stream, late.count_windows(folder, HOUR, HOUR, 4), str(tmp_path / "c")).awaitTermination(200)
    assert VersionedTables(spark, folder).read("late").count() > 0
    late.correct_closed(spark, folder)
    assert {h: n for h, (n, _, _) in seen(spark, folder).items()} == Counter(12 + m // 60 for _, m in posts)
