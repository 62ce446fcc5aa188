"""Activity: rates, levels, hot keywords, liveness of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.words import token_counts
from .posts import moment
from .trends import highlights

LIVE_S, RECENT_S, STALE_S = 90, 600, 3600
SCAN_MS = 6 * 3_600_000


def level_of(age_s: Column) -> Column:
    return F.when(age_s <= LIVE_S, "live").when(age_s <= RECENT_S, "recent").when(age_s <= STALE_S, "stale").otherwise("quiet")


def rates(posts: DataFrame, now_ms: int, scale: int = 1) -> DataFrame:
    """One row: posts, sources, topics, first and last time, counts of the last 1, 5 and 60 minutes, level. scale lengthens the minutes."""
    since = lambda minutes: F.count_if(F.col("published_at") >= moment(now_ms - minutes * 60_000 * scale))
    one = posts.agg(
        F.count("*").alias("posts"), F.count_distinct("source").alias("sources"), F.count_distinct("topic").alias("topics"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest"),
        since(1).alias("last_minute"), since(5).alias("last_five_minutes"), since(60).alias("last_hour"),
    )
    return one.withColumn("level", F.when(F.col("newest").isNull(), "quiet").otherwise(level_of((F.lit(now_ms) - F.unix_millis("newest")) / 1000 / scale)))


def hot_keywords(posts: DataFrame, text: Column, limit: int | None = 12, min_length: int = 4, key: str | None = None) -> DataFrame:
    """Words by the number of posts that have them, with their sources and topics; a post counts once for a word.

    Rows are posts; with a key, rows of equal key are one post, which may have several sources or topics.
    """
    keys = [key] if key else []
    words = posts.select(*keys, "source", "topic", F.explode(token_counts(text, min_length)["token"]).alias("word"))
    words = words.distinct() if key else words
    # Counts by source and topic come first, so a word that all posts have is no hot key.
    parts = words.groupBy("word", "source", "topic").agg(F.count("*").alias("n"))
    out = parts.groupBy("word").agg(F.sum("n").alias("posts"), F.size(F.collect_set("source")).alias("sources"), F.size(F.collect_set("topic")).alias("topics"))
    return out.orderBy(F.desc("posts"), F.desc("sources"), "word").limit(limit) if limit else out


def source_liveness(posts: DataFrame, configs: DataFrame, now_ms: int, hour_ms: int = 3_600_000) -> DataFrame:
    """configs (source, enabled, last_error) with the count of the last hour; sources without posts have 0."""
    recent = posts.filter(F.col("published_at") >= moment(now_ms - hour_ms)).groupBy("source").agg(F.count("*").alias("recent"))
    return configs.join(recent, "source", "left").withColumn("recent", F.coalesce("recent", F.lit(0))).withColumn("ok", F.col("last_error").isNull())


def ingest_level(last_ingest_ms: Column, now_ms: int, scale: int = 1) -> Column:
    """How fresh the last ingest is; quiet without one."""
    return F.coalesce(level_of((F.lit(now_ms) - last_ingest_ms) / 1000 / scale), F.lit("quiet"))


def activity_note(liveness: DataFrame, rate: DataFrame, now_ms: int) -> DataFrame:
    """rate (one row: posts of the window, last_ingest_ms, level) with the note: its code, failing sources where all enabled ones fail, seconds where stale.

    first_error is the error of the failing source with most recent posts, ties by name.
    """
    failing = F.col("enabled") & ~F.col("ok")
    first = F.min_by(F.when(failing, F.col("last_error")), F.when(failing, F.struct((-F.col("recent")).alias("order"), F.col("source"))))
    health = liveness.agg(F.count_if("enabled").alias("enabled"), F.count_if(failing).alias("failing"), first.alias("first_error"))
    both = rate.crossJoin(F.broadcast(health))  # one row each
    all_failed = (F.col("enabled") > 0) & (F.col("failing") == F.col("enabled"))
    code = F.when(all_failed, "all_sources_failed").when((F.col("posts") == 0) & F.col("last_ingest_ms").isNull(), "no_data").otherwise(F.col("level"))
    seconds = F.greatest(F.lit(1), F.floor((F.lit(now_ms) - F.col("last_ingest_ms")) / 1000 + 0.5)).cast("long")
    return both.withColumn("note", F.struct(code.alias("code"), F.when(all_failed, F.col("failing")).alias("sources"), F.when(code == "stale", seconds).alias("seconds")))


def shares(posts: DataFrame, key: str) -> DataFrame:
    """Posts of each value of key, and their share of all."""
    counts = posts.groupBy(key).agg(F.count("*").alias("posts"))
    whole = counts.agg(F.sum("posts").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select(key, "posts", (F.col("posts") / F.col("whole")).alias("share"))  # whole is one row


def source_health(liveness: DataFrame) -> DataFrame:
    """One row: enabled sources, those of them that work, and their share (1 if none is enabled)."""
    out = liveness.agg(F.count_if("enabled").alias("enabled"), F.count_if(F.col("enabled") & F.col("ok")).alias("ok"))
    return out.withColumn("ratio", F.when(F.col("enabled") > 0, F.col("ok") / F.col("enabled")).otherwise(F.lit(1.0)))


def keyword_weights(trends: DataFrame, limit: int | None = 18) -> DataFrame:
    """(keyword, weight): volume over the trends that have the word among their first three keywords; the report of the heaviest."""
    out = trends.select(F.explode(F.slice("keywords", 1, 3)).alias("keyword"), "volume").groupBy("keyword").agg(F.sum("volume").alias("weight")).orderBy(F.desc("weight"), "keyword")
    return out.limit(limit) if limit is not None else out


def activity_snapshot(
    posts: DataFrame, text: Column, trends: DataFrame, configs: DataFrame, now_ms: int, scale: int = 1, scan_ms: int = SCAN_MS, last_ingest_ms: int | None = None, alerts: int = 0,
) -> DataFrame:
    """One row: time, level, note, last ingest, newest post, rates, totals, hot keywords, sources by recent posts, highlights, first error.

    Level and note tell how long ago the last ingest was: last_ingest_ms, or else the newest ingested_at of the posts if they
    have it. Only posts of the last scan_ms count for rates, keywords and sources. scale lengthens minutes and hours.
    configs: (source, enabled, last_error) and, if known, last_ok_at.
    """
    inside = posts.filter(F.col("published_at") >= moment(now_ms - scan_ms * scale))
    seen = F.unix_millis(F.max("ingested_at")) if "ingested_at" in posts.columns else F.lit(None).cast("long")
    totals = posts.agg(F.count("*").alias("items"), F.count_distinct("topic").alias("clusters"), F.coalesce(F.lit(last_ingest_ms).cast("long"), seen).alias("last_ingest_ms")).crossJoin(trends.agg(F.count("*").alias("trends")))
    rate = rates(inside, now_ms, scale).drop("level").crossJoin(totals).withColumn("level", ingest_level(F.col("last_ingest_ms"), now_ms, scale))
    live = source_liveness(inside, configs, now_ms, 3_600_000 * scale)
    one = activity_note(live, rate, now_ms)
    listed = lambda rows, order, name: rows.agg(F.array_sort(F.collect_list(F.struct(*order, *rows.columns))).alias(name))  # noqa: E731  short reports
    words = listed(hot_keywords(inside, text, key="id" if "id" in posts.columns else None).select("word", "posts", "sources", "topics"), [(-F.col("posts")).alias("o1"), (-F.col("sources")).alias("o2")], "keywords")
    known = [c for c in ("last_ok_at", "last_error") if c in live.columns]
    sources = listed(live.select("source", "recent", "ok", "enabled", *known), [(-F.col("recent")).alias("order")], "sources")
    shown = [c for c in ("title",) if c in trends.columns]
    best = highlights(trends).select("topic", *shown, "state", "score", "velocity", "coverage", "volume")
    best = listed(best, [(-F.col("score")).alias("o1"), (-F.col("volume")).alias("o2")], "highlights")
    one = one.select(
        F.lit(now_ms).alias("at_ms"), "level", "note", "last_ingest_ms", "newest", F.struct("last_minute", "last_five_minutes", "last_hour").alias("rate"),
        F.struct("items", "clusters", "trends", F.lit(alerts).cast("long").alias("alerts"), F.col("enabled").alias("sources")).alias("totals"), "first_error",
    )
    return one.crossJoin(words).crossJoin(sources).crossJoin(best)  # one row each
