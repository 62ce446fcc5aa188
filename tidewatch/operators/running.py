"""Running counts of trends: cells of time that are added up and retired, so that a score costs cells, not posts.

A cell has the counts of one topic, source and stretch of `grain_ms`. Posts exactly at a stretch's
start are kept apart, since windows are closed on one side: with a now and options that are whole
multiples of the grain, every window is made of whole cells and scores equal those of the posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import engagement
from .trends import TrendOptions, score_sources

CELL = ("topic", "source", "at_ms", "edge")


def whole(now_ms: int, grain_ms: int) -> int:
    """now, or the next whole multiple of the grain."""
    return -(-now_ms // grain_ms) * grain_ms


def count_cells(posts: DataFrame, grain_ms: int, sign: int = 1) -> DataFrame:
    """(topic, source, at_ms, edge, items, engagement, first_ms, last_ms) of posts; with sign -1 to be taken away."""
    ms = F.unix_millis("published_at")
    rows = posts.select("topic", "source", (F.floor(ms / grain_ms) * grain_ms).alias("at_ms"), (ms % grain_ms == 0).alias("edge"), ms.alias("ms"), engagement(posts.columns).alias("engagement"))
    return rows.groupBy(*CELL).agg((F.count("*") * sign).alias("items"), (F.sum("engagement") * sign).alias("engagement"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))


def merge_cells(*cells: DataFrame) -> DataFrame:
    """Sums of cells. Order and split don't matter; what is taken away must have been added and leaves the times as they were."""
    both = cells[0]
    for more in cells[1:]:
        both = both.unionByName(more)
    return both.groupBy(*CELL).agg(F.sum("items").alias("items"), F.sum("engagement").alias("engagement"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def retire_cells(cells: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """Cells older than the baseline become one for each topic and source (at_ms null): of them only number and times count."""
    old = F.col("at_ms") < now_ms - options.baseline_ms
    gone = cells.withColumns({"at_ms": F.when(~old, F.col("at_ms")), "edge": F.coalesce(~old, F.lit(False)) & F.col("edge"), "engagement": F.when(old | F.col("at_ms").isNull(), F.lit(0.0)).otherwise(F.col("engagement"))})
    return merge_cells(gone)


def cells_by_source(cells: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """The sums by topic and source that trends are scored from, as by_source() gives them for posts."""
    if any(x % options.bucket_ms for x in (options.window_ms, options.baseline_ms)):
        raise ValueError("windows must be whole numbers of buckets")

    def after(age: int) -> Column:
        """Whether a cell's posts are younger than age: they come after now - age."""
        at = now_ms - age
        return F.coalesce((F.col("at_ms") > at) | ((F.col("at_ms") == at) & ~F.col("edge")), F.lit(False))

    def since(age: int) -> Column:
        return F.coalesce(F.col("at_ms") >= now_ms - age, F.lit(False))

    n = options.buckets
    inside = since(options.window_ms)
    count = lambda c: F.sum(F.when(c, F.col("items")).otherwise(0))
    buckets = [count(inside & after((n - i) * options.bucket_ms) & ~after((n - 1 - i) * options.bucket_ms)).alias(f"b{i}") for i in range(n)]
    sums = cells.groupBy("topic", "source").agg(
        F.sum("items").alias("items"), count(inside).alias("volume"), count(~inside & since(options.baseline_ms)).alias("baseline"),
        F.sum(F.when(inside, F.col("engagement")).otherwise(0.0)).alias("engagement"), F.timestamp_millis(F.min("first_ms")).alias("first_seen"), F.timestamp_millis(F.max("last_ms")).alias("last_seen"), *buckets,
    )
    return sums.filter("items > 0")


def score_cells(cells: DataFrame, now_ms: int, options: TrendOptions = TrendOptions()) -> DataFrame:
    """score_topics() of the posts that were counted; now_ms must be a whole multiple of the grain."""
    return score_sources(cells_by_source(cells, now_ms, options), now_ms, options)


def distinct_sketches(posts: DataFrame, column: str, bucket_ms: int, bits: int = 12) -> DataFrame:
    """(topic, at_ms, sketch): a HyperLogLog of the column's values in each topic and bucket, of 2**bits cells at most."""
    at = F.floor(F.unix_millis("published_at") / bucket_ms) * bucket_ms
    return posts.groupBy("topic", at.alias("at_ms")).agg(F.hll_sketch_agg(F.col(column), bits).alias("sketch"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """One sketch for each topic and bucket of sketches over any split of the posts, also where posts repeat."""
    both = sketches[0]
    for more in sketches[1:]:
        both = both.unionByName(more)
    return both.groupBy("topic", "at_ms").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_since(sketches: DataFrame, since_ms: int) -> DataFrame:
    """(topic, n): about how many distinct values each topic has in the buckets from a time on; off by 1.6 percent, as a rule, at 12 bits."""
    inside = sketches.filter(F.col("at_ms") >= since_ms)
    return inside.groupBy("topic").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
