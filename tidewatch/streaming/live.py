"""The operators on streams: live posts, dedup, windows, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import primary_language

COMMIT = "did string, time_us long, kind string, commit struct<operation:string,collection:string,rkey:string,record:struct<text:string,langs:array<string>,createdAt:string>>"


def live_posts(messages: DataFrame, languages: list[str] | None = None, keywords: list[str] | None = None, least: int = 12) -> DataFrame:
    """Created posts of a stream of JSON commits (value), with enough text, in the languages, with any keyword."""
    m = messages.select(F.from_json("value", COMMIT).alias("m")).select("m.*").filter("kind = 'commit' AND commit.operation = 'create'")
    posts = m.select(
        F.concat_ws("/", F.lit("at:/"), "did", "commit.collection", "commit.rkey").alias("id"), F.lit("bluesky").alias("source"), F.col("did").alias("author"), F.col("commit.record.text").alias("body"),
        F.col("commit.record.langs").alias("langs"), F.timestamp_micros("time_us").alias("published_at"),
    ).filter(F.length("body") >= least)
    if languages:
        posts = posts.filter(F.col("langs").isNull() | (F.size("langs") == 0) | F.exists("langs", lambda x: primary_language(x).isin(*languages)))
    if keywords:
        posts = posts.filter(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower("body"), k)))
    return posts


def with_handles(posts: DataFrame, handles: DataFrame) -> DataFrame:
    """author names from a table (author, handle); unknown authors keep their id."""
    return posts.join(handles, "author", "left").withColumn("handle", F.coalesce("handle", "author"))


def dedup_stream(posts: DataFrame, delay: str = "6 hours") -> DataFrame:
    return posts.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["id"])


def tumbling_counts(posts: DataFrame, width: str = "2 minutes", delay: str = "6 hours") -> DataFrame:
    """Posts by topic, source and window; windows start at whole multiples of the epoch."""
    w = posts.withWatermark("published_at", delay).groupBy(F.window("published_at", width), "topic", "source").agg(F.count("*").alias("posts"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "topic", "source", "posts")


def rolling_rates(posts: DataFrame, width: str = "1 hour", slide: str = "1 minute", delay: str = "6 hours") -> DataFrame:
    w = posts.withWatermark("published_at", delay).groupBy(F.window("published_at", width, slide)).agg(F.count("*").alias("posts"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "posts")


def topic_sessions(posts: DataFrame, gap: str = "6 hours", delay: str = "6 hours") -> DataFrame:
    """Spans of a topic without a pause of `gap`."""
    s = posts.withWatermark("published_at", delay).groupBy(F.session_window("published_at", gap), "topic").agg(F.count("*").alias("posts"))
    return s.select("topic", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "posts")


def metric_maxima(posts: DataFrame, metrics: list[str]) -> DataFrame:
    """Largest value of each metric seen so far, by id; for update mode."""
    return posts.groupBy("id").agg(*[F.max(m).alias(m) for m in metrics])


def ingest_stream(posts: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ingest(batch, number) on each micro-batch; without `every` on all there is, and ends."""
    w = posts.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def newest_of_batch(most: int = 400, counted: Callable[[int, int], None] | None = None, then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ingest_stream: hands on the newest `most` posts of a batch (a buffer of bounded size) and tells (batch, dropped).

    The bound is the feature of a live view; ingest without it to keep all posts.
    """

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            if counted:
                counted(number, max(0, batch.count() - most))
            if then:
                then(batch.orderBy(F.desc("published_at"), "id").limit(most), number)
        finally:
            batch.unpersist()

    return take
