"""The ingest cycle on micro-batches: posts stored once and refreshed, topics, trends, points and alerts brought up to date.

A batch reads and writes the parts of the posts that it touches, the posts of the window, and what
grows with topics: their states and cells. All tables of a batch are seen at once when its version is
committed, and a batch that is run again does nothing new.

Tables: posts, recent (those of the window), topics (states), cells, merged (topic, merged), trends,
points, events, fired, errors (source, record, message, at_ms), reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators import alerts, topics as T, trends
from ..operators.posts import dedup_posts, retain, upsert_posts
from ..operators.running import count_cells, merge_cells, retire_cells, score_cells, whole
from ..operators.store import VersionedTables
from ..operators.trends import TrendOptions, age_ms
from ..session import live_folders, release_since, written
from ..sources.normalize import normalize_items
from ..sources.records import told_apart

RETENTION_DAYS, GRAIN_MS, KEEP_POINTS = 30.0, 1000, 720


def _renamed(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the topics that theirs were merged into."""
    columns = rows.columns
    return rows.join(links.select("topic", "merged"), "topic", "left").withColumn("topic", F.coalesce("merged", "topic")).select(*columns)


def archived(store: VersionedTables, now_ms: int, days: float = RETENTION_DAYS) -> DataFrame | None:
    """The stored posts under the topics they have now; those past retention go unseen until their part is written again."""
    posts = store.read("posts")
    return posts and retain(_renamed(posts, store.read("merged")), now_ms, days)


def trend_series(store: VersionedTables, keep: int = KEEP_POINTS) -> DataFrame | None:
    """Points of the trends: the last one of each topic and minute, the newest `keep` of each topic."""
    points = store.read("points")
    return points and trends.upsert_points(points.limit(0).drop("at_ms"), _last_points(points), keep)


def _last_points(points: DataFrame) -> DataFrame:
    rest = [c for c in points.columns if c not in ("topic", "minute", "at_ms")]
    return points.groupBy("topic", "minute").agg(F.max_by(F.struct(*rest), "at_ms").alias("p")).select("topic", "minute", "p.*")


def ingest_into(
    folder: str, now_ms: Callable[[], int], rules: DataFrame, options: TrendOptions = TrendOptions(), aliases: DataFrame | None = None, names: DataFrame | None = None,
    days: float = RETENTION_DAYS, grain_ms: int = GRAIN_MS, parts: int = 64, listener: Callable[[DataFrame, DataFrame], None] | None = None,
) -> Callable[[DataFrame, int], None]:
    """For ingest_stream: takes up a batch of raw records below the folder, failed ones among them (see records.py) or not.

    A record that can't be taken up goes to errors and keeps no other back.

    A post that is stored and whose topic is alive keeps it, and its metrics rise; the others join a topic or
    open one. Then twins are merged, topics without posts within retention leave, all topics are scored,
    a point is kept for each, and rules fire. listener gets the trends and the new events of a committed batch.
    aliases: (alias, slug); names: (slug, name).
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, now_ms()
        store = VersionedTables(spark, folder)
        made = store.batch(number)
        if not made.done:
            _take_up(made, batch, now)
            made.commit()
            if listener and not made.now("trends").isEmpty():
                listener(made.now("trends"), made.added("events"))

    def _take_up(made, batch: DataFrame, now: int) -> None:
        spark, at, scratch = batch.sparkSession, whole(now, grain_ms), live_folders()

        def kept(rows: DataFrame, label: str) -> DataFrame:
            return written(rows, f"ingest-{label}")

        tie = F.xxhash64("title", "body", "url")
        good, failed = told_apart(batch)
        made.append("errors", failed.withColumn("at_ms", F.lit(now)))
        errors = made.added("errors").count()
        raw = normalize_items(good, now, aliases, hashes=False).withColumn("tie_", tie)
        items = kept(dedup_posts(raw, tie="tie_").drop("tie_"), "items")
        stored = made.stored("posts", items)
        links = made.stored("merged")
        states = made.stored("topics")
        alive, open_ = None, items.withColumn("topic", F.lit(None).cast("string"))
        if stored is not None:
            active = T.active_topics(T.topics_of(states), now)
            before = kept(_renamed(retain(stored, now, days), links).join(items.select("id"), "id", "left_semi"), "before")
            alive = kept(T.keep_known(items, before, active)[0], "alive")
            open_ = items.join(alive.select("id"), "id", "left_anti")
        texts = open_.withColumns({"plain": F.concat_ws(" ", "title", "body"), "twice": F.concat_ws(" ", "title", "title", "body")})
        featured = kept(T.features(texts, "plain", "twice"), "features")
        placed = T.assign_topics(featured, active).select("id", "topic") if stored is not None else featured.select("id", F.lit(None).cast("string").alias("topic"))
        placed = kept(placed, "assigned")
        opened = T.open_topics(featured.join(placed.filter("topic IS NULL").select("id"), "id", "left_semi"))
        placed = kept(placed.filter("topic IS NOT NULL").union(opened), "placed")

        of_all = placed if alive is None else placed.union(alive)
        fresh = items.drop("seen").join(of_all, "id").join(featured.select("id", "keywords", "simhash"), "id", "left")
        changed = kept(fresh if stored is None else upsert_posts(before, fresh, ("topic",)), "changed")
        made.upsert("posts", changed, lambda old, new: retain(old.join(new.select("id"), "id", "left_anti").unionByName(new), now, days), parts=parts)

        cells = [count_cells(changed, grain_ms)] + ([count_cells(before.join(alive.select("id"), "id", "left_semi"), grain_ms, -1), made.stored("cells")] if stored is not None else [])
        states = T.merge_states(T.topic_states(featured.join(placed, "id")), *([states] if stored is not None else []))
        states = kept(states, "states")
        new_links = kept(T.merge_topics(T.active_topics(T.topics_of(states), now)).filter("merged <> topic"), "links")
        cells = retire_cells(merge_cells(*[_renamed(c, new_links) for c in cells]), at, options)
        cells = made.replace("cells", trends.retain_topics(cells, now, days))
        states = made.replace("topics", T.merge_states(_renamed(states, new_links)).join(cells.select("topic").distinct(), "topic", "left_semi"))
        earlier = links.withColumnRenamed("topic", "from_").withColumnRenamed("merged", "topic") if links is not None else None
        all_links = new_links.select("topic", "merged") if earlier is None else _renamed(earlier, new_links).select(F.col("from_").alias("topic"), F.col("topic").alias("merged")).union(new_links.select("topic", "merged"))
        made.replace("merged", all_links.join(states.select(F.col("topic").alias("merged")), "merged", "left_semi").select("topic", "merged"))

        of_window = changed if stored is None else made.stored("recent").join(changed.select("id"), "id", "left_anti").unionByName(changed)
        recent = made.replace("recent", _renamed(of_window, new_links).filter(age_ms(now) <= options.window_ms))
        known_names = names if names is not None else spark.createDataFrame([], "slug string, name string")
        scored = trends.described(score_cells(cells, at, options), T.topics_of(states), recent, known_names, now, options)
        if stored is not None:
            previous = made.stored("trends")
            shown = previous.select("topic", F.col("title").alias("title_before"))
            scored = scored.join(shown, "topic", "left").withColumn("title", F.when(F.col("volume") == 0, F.coalesce("title_before", "title")).otherwise(F.col("title"))).drop("title_before")
            scored = trends.acknowledged_kept(scored, previous)
        else:
            scored = scored.withColumn("acknowledged", F.lit(False))
        scored = made.replace("trends", trends.retain_trends(scored, now, days))
        minute = F.timestamp_millis(F.lit(now - now % 60_000))
        made.append("points", scored.select("topic", minute.alias("minute"), "score", "volume", "velocity", F.lit(now).alias("at_ms")))

        fired = made.stored("fired")
        fired = fired if fired is not None else spark.createDataFrame([], "rule_id string, topic string, at_ms long")
        made.append("events", alerts.evaluate_rules(rules, scored, now, fired, recent))
        made.replace("fired", alerts.fired_after(fired, made.added("events"), now))
        known = 0 if stored is None else before.count()
        n = items.agg(F.coalesce(F.sum("seen"), F.lit(0)).cast("long").alias("seen"), F.count("*").alias("ids"))
        made.append("reports", n.select(F.lit(now).alias("at_ms"), (F.col("seen") + errors).alias("fetched"), (F.col("ids") - known).alias("inserted"), (F.col("seen") - F.col("ids") + known).alias("duplicates"), F.lit(errors).cast("long").alias("errors")))
        release_since(spark, scratch)

    return run
