"""Trend scoring: one pass over the posts of the baseline window for all topics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import clamp01, engagement, half_up, log_norm
from ..functions.text import simhash_similarity, title_from_keywords


@dataclass(frozen=True)
class TrendOptions:
    window_ms: int = 30 * 60_000
    bucket_ms: int = 2 * 60_000
    buckets: int = 15
    baseline_ms: int = 6 * 3_600_000
    #: The age limits of states and reasons are multiplied by this.
    age_scale: float = 1.0
    weights: dict = field(default_factory=lambda: {"volume": 0.34, "velocity": 0.3, "coverage": 0.16, "engagement": 0.12, "novelty": 0.08})


def age_ms(now_ms: int, at: str = "published_at") -> Column:
    return F.lit(now_ms) - F.unix_millis(F.col(at))


def by_source(posts: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """Sums by topic and source; a topic that is everywhere is summed before it meets in one task."""
    age = age_ms(now_ms)
    inside = age <= options.window_ms
    index = F.lit(options.buckets - 1) - F.floor(age / options.bucket_ms)
    buckets = [F.count_if(inside & (age >= 0) & (index == i)).alias(f"b{i}") for i in range(options.buckets)]
    return posts.groupBy("topic", "source").agg(
        F.count("*").alias("items"), F.count_if(inside).alias("volume"), F.count_if(~inside & (age <= options.baseline_ms)).alias("baseline"),
        F.sum(F.when(inside, engagement(posts.columns)).otherwise(F.lit(0.0))).alias("engagement"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"), *buckets,
    )


def state_of(velocity: Column, coverage: Column, volume: Column, age_min: Column, scale: float) -> Column:
    return (
        F.when((coverage >= 3) & (velocity >= 5) & (volume >= 25), "breaking")
        .when((velocity >= 2.5) & (volume >= 8) & (age_min <= 90 * scale), "emerging")
        .when(velocity >= 1.6, "rising")
        .when((velocity < 0.6) & (age_min > 30 * scale), "fading")
        .otherwise("quiet")
    )


def reason_of(velocity: Column, coverage: Column, volume: Column, age_min: Column, scale: float) -> Column:
    return F.when((coverage >= 3) & (velocity >= 2.5), "multi_source").when(velocity >= 3, "velocity_spike").when((age_min <= 20 * scale) & (volume >= 5), "new_topic").otherwise("sustained")


def score_topics(posts: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """One row for each topic of posts (topic, source, published_at and metrics).

    Rounded as shown to readers; growth and velocity decide state and reason before rounding, and stay as velocity_x and growth_x.
    """
    return score_sources(by_source(posts, now_ms, options), now_ms, options)


def score_sources(per_source: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """The same from sums by topic and source."""
    n, half = options.buckets, options.buckets // 2
    share = F.when(F.col("volume") > 0, F.struct((-F.col("volume")).alias("order"), F.col("source"), F.col("volume").alias("count")))
    topics = per_source.groupBy("topic").agg(
        *[F.sum(c).alias(c) for c in ("items", "volume", "baseline", "engagement", *[f"b{i}" for i in range(n)])],
        F.count_if(F.col("volume") > 0).alias("coverage"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.collect_list(share)).alias("parts"),
    )
    total = lambda indexes: sum((F.col(f"b{i}") for i in indexes), F.lit(0))
    topics = topics.withColumn("recent", total(range(half, n))).withColumn("previous", total(range(half)))
    baseline_buckets = max(1, int((options.baseline_ms - options.window_ms) / options.bucket_ms + 0.5))
    exact = topics.withColumns({
        "growth_x": (F.col("recent") - F.col("previous")) / F.greatest("previous", F.lit(1)),
        "velocity_x": F.col("recent") / (n - half) / F.greatest(F.col("baseline") / baseline_buckets, F.lit(0.25)),
        "age_min": age_ms(now_ms, "first_seen") / 60000,
    })
    novelty = clamp01(1 - F.greatest(F.col("age_min") * 60000, F.lit(0)) / options.baseline_ms)
    span = (F.unix_millis("last_seen") - F.unix_millis("first_seen")) / 60000
    cohesion = F.when(F.col("items") < 2, F.lit(1.0)).otherwise(clamp01(1 - F.col("items") / F.greatest(span, F.lit(1.0)) / 12))
    w = options.weights
    signal = w["volume"] * log_norm(F.col("volume"), 300) + w["velocity"] * log_norm(F.col("velocity_x"), 12) + w["coverage"] * clamp01((F.col("coverage") - 1) / 4) + w["engagement"] * log_norm(F.col("engagement"), 50000) + w["novelty"] * novelty
    at = (F.col("velocity_x"), F.col("coverage"), F.col("volume"), F.col("age_min"), options.age_scale)
    return exact.select(
        "topic", F.when(F.col("volume") == 0, F.lit(0.0)).otherwise(half_up(100 * clamp01(signal))).cast("long").alias("score"), state_of(*at).alias("state"), reason_of(*at).alias("reason"),
        half_up(F.col("velocity_x"), 2).alias("velocity"), half_up(F.col("growth_x"), 3).alias("growth"), "volume", "coverage", half_up(F.col("engagement")).cast("long").alias("engagement"),
        half_up(novelty, 2).alias("novelty"), half_up(cohesion, 2).alias("cohesion"), "first_seen", "last_seen",
        F.transform("parts", lambda p: F.struct(p["source"].alias("source"), (p["count"] / F.col("volume")).alias("share"), p["count"].alias("count"))).alias("sources"), F.array(*[F.col(f"b{i}") for i in range(n)]).alias("sparkline"),
        "velocity_x", "growth_x",
    )


def ranked(trends: DataFrame) -> DataFrame:
    """All trends with their rank by score, volume and name.

    Ranks start from counts by score and volume, a short table, so each pair of these is ranked on its own.
    """
    counts = trends.groupBy("score", "volume").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("score"), F.desc("volume")).rowsBetween(Window.unboundedPreceding, -1))
    start = counts.select("score", "volume", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("score", "volume").orderBy("topic"))
    return trends.withColumn("own", own).join(start, ["score", "volume"]).withColumn("rank", F.col("before") + F.col("own")).drop("own", "before")


def query_trends(trends: DataFrame, limit: int | None = 40, min_score: float = 0, states: list[str] | None = None) -> DataFrame:
    """Trends of the states from a score on, best first."""
    out = trends.filter(F.col("score") >= min_score)
    out = out.filter(F.col("state").isin(states)) if states else out
    out = out.orderBy(F.desc("score"), F.desc("last_seen"), "topic")
    return out.limit(limit) if limit is not None else out


def radar(trends: DataFrame, limit: int = 40, min_score: float = 0, states: list[str] | None = None, filter_first: bool = False) -> DataFrame:
    """The best trends with volume; the limit comes before the filter unless filter_first."""
    return query_trends(trends.filter("volume > 0") if filter_first else trends, limit, min_score, states).filter("volume > 0")


def highlights(trends: DataFrame, n: int = 5) -> DataFrame:
    """The best n trends that are not quiet, by score and volume."""
    return trends.filter("state <> 'quiet'").orderBy(F.desc("score"), F.desc("volume"), "topic").limit(n)


def hot(trends: DataFrame, announced: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Breaking and emerging trends; with announced (topic) only those that are not in it, with most the best by score."""
    out = trends.filter(F.col("state").isin("breaking", "emerging"))
    out = out.join(announced.select("topic"), "topic", "left_anti") if announced is not None else out
    return out.orderBy(F.desc("score"), F.desc("volume"), "topic").limit(most) if most is not None else out


def matching(trends: DataFrame, words: str) -> DataFrame:
    """Trends with the words in their title or a keyword, whatever the case; words of less than two letters match none."""
    needle = words.strip().lower()
    inside = F.exists("keywords", lambda x: F.contains(F.lower(x), F.lit(needle)))
    return trends.filter((F.contains(F.lower("title"), F.lit(needle)) | inside) if len(needle) >= 2 else F.lit(False))


def representatives(posts: DataFrame, now_ms: int, options: TrendOptions = TrendOptions(), first: int = 24, order: str = "ingested_at") -> DataFrame:
    """(topic, id, title, body): of the first posts of each topic's window the one most like the very first; a title counts 0.05.

    Posts have topic, id, published_at, title, body, simhash and the column of the order; ties in it go by id. A
    topic without posts in the window takes all of its posts.
    """
    place_of = F.struct((age_ms(now_ms) > options.window_ms).alias("outside"), F.col(order).alias("at"), F.col("id"))
    rows = posts.withColumn("order_", place_of).withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("order_"))).filter(F.col("place") <= first)
    one = rows.filter("place = 1").select("topic", F.col("simhash").alias("of_first"), F.col("order_.outside").alias("only_older"))
    both = rows.join(one, "topic").filter(~F.col("order_.outside") | F.col("only_older"))
    titled = F.when(F.length(F.trim(F.coalesce("title", F.lit("")))) > 0, 0.05).otherwise(0.0)
    score = F.round(simhash_similarity(F.col("simhash"), F.col("of_first")) + titled, 9)
    best = both.groupBy("topic").agg(F.min_by(F.struct("id", "title", "body"), F.struct((-score).alias("s"), F.col("order_"))).alias("best"))
    return best.select("topic", "best.*")


def title_of(names: Column, keywords: Column, title: Column, body: Column) -> Column:
    """The first two entity names; else the representative's text if it has twelve letters, cut at 90; else the keywords."""
    text = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.trim(body), F.lit(""))
    cut = F.when(F.length(text) > 90, F.concat(F.rtrim(F.substring(text, 1, 89)), F.lit("…"))).otherwise(text)
    return F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, 2), " · ")).when(F.length(text) >= 12, cut).otherwise(title_from_keywords(keywords, text))


def described(trends: DataFrame, topics: DataFrame, posts: DataFrame, names: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """Trends with title, keywords, entities, the newest posts' ids and the reason's numbers.

    topics: topic, keywords, entities. names: slug, name; entities without a name keep their slug. A trend whose
    topic is not in topics has neither keywords nor entities.
    """
    none = F.array().cast("array<string>")
    terms = topics.select("topic", F.slice("keywords", 1, 8).alias("keywords"), "entities")
    labels = topics.select("topic", F.posexplode("entities").alias("at", "slug")).join(names.select("slug", "name"), "slug", "left")
    labels = labels.withColumn("name", F.coalesce("name", "slug")).filter("name <> ''").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("l")).select("topic", F.col("l.name").alias("names"))
    samples = newest_posts(posts.filter(age_ms(now_ms) <= options.window_ms)).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("s")).select("topic", F.col("s.id").alias("sample_ids"))
    best = representatives(posts, now_ms, options).select("topic", F.col("title").alias("of_title"), F.col("body").alias("of_body"))
    out = trends
    for more in (terms, labels, samples, best):
        out = out.join(more, "topic", "left")
    empty = {c: F.coalesce(c, none) for c in ("keywords", "entities", "names")} | {"sample_ids": F.coalesce("sample_ids", F.array().cast(samples.schema["sample_ids"].dataType))}
    out = out.withColumns(empty).withColumn("title", title_of(F.col("names"), F.col("keywords"), F.col("of_title"), F.col("of_body")))
    params = F.struct(
        (F.floor(F.col("velocity_x") * 10 + 0.5) / 10).alias("velocity"), F.floor(F.col("growth_x") * 100 + 0.5).cast("long").alias("growth"), F.col("coverage").alias("sources"), "volume",
        F.lit(options.window_ms / 60000).alias("window_min"),
    )
    return out.withColumn("reason_params", params).drop("of_title", "of_body", "names")


def acknowledged_kept(trends: DataFrame, previous: DataFrame) -> DataFrame:
    """Trends with acknowledged as in the evaluation before; new ones are not."""
    return trends.join(previous.select("topic", "acknowledged"), "topic", "left").withColumn("acknowledged", F.coalesce("acknowledged", F.lit(False)))


def with_posts(topics: DataFrame, posts: DataFrame) -> DataFrame:
    """Topics (or trends, or their points) that still have a post; the others are stale."""
    return topics.join(posts.select("topic").distinct(), "topic", "left_semi")


def retain_trends(trends: DataFrame, now_ms: int, days: float = 30) -> DataFrame:
    """Trends but those that are both older than so many days and acknowledged."""
    old = F.unix_millis("last_seen") < now_ms - int(days * 86_400_000)
    return trends.filter(~(old & F.coalesce("acknowledged", F.lit(False))))


def retain_topics(cells: DataFrame, now_ms: int, days: float = 30) -> DataFrame:
    """Cells of the topics that have a post within so many days."""
    last = cells.groupBy("topic").agg(F.max("last_ms").alias("last")).filter(F.col("last") >= now_ms - int(days * 86_400_000))
    return cells.join(last.select("topic"), "topic", "left_semi")


def by_last_seen(topics: DataFrame) -> DataFrame:
    return topics.orderBy(F.desc("last_seen"), "topic")


def stale(topics: DataFrame, posts: DataFrame) -> DataFrame:
    """(topic) of topics without a post."""
    return topics.select("topic").distinct().join(posts.select("topic").distinct(), "topic", "left_anti")


def upsert_topics(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with fresh: of known topics the fresh columns, but the earliest first_seen and the latest last_seen."""
    rest = [c for c in stored.columns if c not in ("topic", "first_seen", "last_seen")]
    both = stored.select("*", F.lit(0).alias("new")).unionByName(fresh.select(*stored.columns, F.lit(1).alias("new")))
    out = both.groupBy("topic").agg(F.max_by(F.struct(*rest), "new").alias("last"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.select("topic", "last.*", "first_seen", "last_seen").select(*stored.columns)


def upsert_points(stored: DataFrame, fresh: DataFrame, keep: int = 720) -> DataFrame:
    """Trend points with fresh ones: one for a topic and minute, the fresh one if there are two; the newest `keep` of each topic."""
    both = stored.select("*", F.lit(0).alias("new")).unionByName(fresh.select(*stored.columns, F.lit(1).alias("new")))
    rest = [c for c in stored.columns if c not in ("topic", "minute")]
    one = both.groupBy("topic", "minute").agg(F.max_by(F.struct(*rest), "new").alias("last")).select("topic", "minute", "last.*")
    newest = Window.partitionBy("topic").orderBy(F.desc("minute"))
    return one.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep).select(*stored.columns)


def history_of(evaluations: DataFrame) -> DataFrame:
    """Each evaluation of a topic (topic, at_ms, score, velocity, state) with the one before and whether it has risen.

    It has if velocity is half as much again and the score five points more; a first one, if it isn't quiet.
    """
    own = Window.partitionBy("topic").orderBy("at_ms")
    out = evaluations.withColumns({"before_score": F.lag("score").over(own), "before_velocity": F.lag("velocity").over(own)})
    risen = (F.col("velocity") >= F.col("before_velocity") * 1.5) & (F.col("score") >= F.col("before_score") + 5)
    return out.withColumn("escalated", F.when(F.col("before_score").isNull(), F.col("state") != "quiet").otherwise(risen))


def trend_points(posts: DataFrame, keep: int = 720) -> DataFrame:
    """Volume and value of each topic and minute: one point a minute, the newest `keep` of each topic."""
    points = posts.groupBy("topic", F.date_trunc("minute", "published_at").alias("minute")).agg(F.count("*").alias("volume"), F.sum(engagement(posts.columns)).alias("engagement"))
    newest = Window.partitionBy("topic").orderBy(F.desc("minute"))
    return points.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep).drop("n")


def newest_posts(posts: DataFrame, n: int = 8) -> DataFrame:
    """Ids of the newest n posts of each topic, newest first."""
    ranks = Window.partitionBy("topic").orderBy(F.desc("published_at"), "id")
    return posts.select("topic", "id", "published_at", F.row_number().over(ranks).alias("place")).filter(F.col("place") <= n)

