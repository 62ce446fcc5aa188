"""Counts by window that rows behind the watermark correct afterwards.

A micro-batch counts the rows of windows that are open; rows of windows closed before it go to a side
table. A batch job adds the side table to the closed windows, each batch's late rows once, whether the stream or
the job is run again or dies in between.

Tables: rows (start_ms, id), counts (start_ms, topic, source, posts), late (start_ms, id, topic, source,
behind_ms), clock (watermark_ms). corrections/ is a store of its own, whose version n holds what
the late rows of all batches up to n add.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.store import VersionedTables
from ..session import live_folders, release_since, written

_KEYS = ("start_ms", "topic", "source")


def _summed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return stored.unionByName(fresh).groupBy(*_KEYS).agg(F.sum("posts").alias("posts"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEYS).agg(F.count("*").alias("posts"))


def count_windows(folder: str, width_ms: int = 120_000, delay_ms: int = 21_600_000, parts: int = 64, forget_ms: int | None = None) -> Callable[[DataFrame, int], None]:
    """For ingest_stream: counts posts (id, topic, source, published_at) by topic, source and window.

    The watermark is the newest time of the batches before, less delay_ms; a row whose window ends at it or
    before is late. A repeated row (same id in the same window) counts once; rows without id or time don't
    count. A batch reads and rewrites the parts that hold its windows. With forget_ms, ids that far behind the
    watermark are dropped, and a row repeated even later counts again.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark, scratch = batch.sparkSession, live_folders()
        made = VersionedTables(spark, folder).batch(number)
        if made.done:
            return
        clock = made.stored("clock")
        mark = clock.first().watermark_ms if clock is not None else None
        at = F.unix_millis("published_at")
        rows = batch.filter("id IS NOT NULL AND published_at IS NOT NULL").select("id", "topic", "source", at.alias("at_ms"), (at - F.pmod(at, F.lit(width_ms))).alias("start_ms"))
        once = written(rows.groupBy("start_ms", "id").agg(F.min(F.struct("at_ms", "topic", "source")).alias("first")).select("start_ms", "id", "first.*"), "window-rows")
        known = made.stored("rows", once, "start_ms")
        fresh = once if known is None else once.join(known, ["start_ms", "id"], "left_anti")
        closed = F.lit(False) if mark is None else F.col("start_ms") + width_ms <= F.lit(mark)
        fresh = written(fresh.withColumn("closed", closed), "window-fresh")
        kept = F.lit(True) if forget_ms is None or mark is None else F.col("start_ms") >= F.lit(mark - forget_ms)
        made.upsert("rows", fresh.select("start_ms", "id"), lambda old, new: old.unionByName(new).filter(kept), "start_ms", parts)
        counts = written(_counted(fresh.filter("NOT closed")), "window-counts")
        made.upsert("counts", counts, _summed, "start_ms", parts)
        behind = (F.lit(mark).cast("long") - F.col("at_ms")).alias("behind_ms")
        made.append("late", fresh.filter("closed").select("start_ms", "id", "topic", "source", behind))
        newest = once.agg(F.max("at_ms").alias("ms")).first().ms
        marks = [m for m in (mark, None if newest is None else newest - delay_ms) if m is not None]
        made.replace("clock", spark.createDataFrame([(max(marks, default=None),)], "watermark_ms long"))
        made.commit()
        release_since(spark, scratch)

    return take


def correct_closed(spark: SparkSession, folder: str, parts: int = 64) -> int:
    """Adds the late rows of batches committed since the last call to the windows they belong to; the number of windows changed.

    May run beside the stream and as often as one likes: what a batch brought late is added once.
    """
    store, corrections = VersionedTables(spark, folder), VersionedTables(spark, f"{folder.rstrip('/')}/corrections")
    newest = store.versions()[-1:]
    if not newest:
        return 0
    made = corrections.batch(newest[0])
    if made.done:
        return 0
    scratch, applied = live_folders(), max(corrections.versions(), default=-1)
    late = store.tables(newest[0])["late"]
    fresh = store.parts_of("late", late, {int(p) for p in late["parts"] if int(p) > applied})
    fresh = written(_counted(fresh), "late-counts")
    made.upsert("counts", fresh, _summed, "start_ms", parts)
    made.commit()
    changed = fresh.count()
    release_since(spark, scratch)
    return changed


def window_counts(spark: SparkSession, folder: str, width_ms: int = 120_000) -> DataFrame:
    """(start_ms, topic, source, posts, late_posts, closed): the windows as they stand; posts has the late ones that were added."""
    store, extra = VersionedTables(spark, folder), VersionedTables(spark, f"{folder.rstrip('/')}/corrections").read("counts")
    counts = store.read("counts")
    if counts is None:
        return spark.createDataFrame([], "start_ms long, topic string, source string, posts long, late_posts long, closed boolean")
    both = counts.withColumn("late_posts", F.lit(0).cast("long"))
    if extra is not None:
        both = both.unionByName(extra.withColumn("late_posts", F.col("posts")))
    mark = store.read("clock").first().watermark_ms
    closed = F.coalesce(F.col("start_ms") + width_ms <= F.lit(mark).cast("long"), F.lit(False))
    return both.groupBy(*_KEYS).agg(F.sum("posts").alias("posts"), F.sum("late_posts").alias("late_posts")).withColumn("closed", closed)
