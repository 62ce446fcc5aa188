"""Posts: the tables as posts, dedup with metric maxima, feed and search queries, retention, upserts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scores import engagement_key
from ..functions.text import normalize_text
from ..functions.words import token_counts
from ..session import load

METRICS = ("likes", "replies", "reposts", "score", "comments", "stars")


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as posts: topic is the event type, source one of six by user, likes the whole value."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("topic"), F.concat(F.lit("s"), (F.col("user_id") % 6).cast("string")).alias("source"), F.col("user_id").alias("author"),
        F.col("ts").cast("timestamp").alias("published_at"), F.floor("value").cast("long").alias("likes"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as posts, with a time and likes that follow from the id and the length."""
    d = load(spark, sf_dir, "documents")
    start = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return d.select(
        F.col("doc_id"), F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), "source", "lang", F.col("text").alias("body"), (F.col("n_chars") % 97).alias("likes"),
        F.timestamp_millis(F.unix_millis(start) - (F.col("doc_id") * 7919 % 43200) * 1000).alias("published_at"),
    )


def latest_ms(posts: DataFrame, at: str = "published_at") -> int:
    """The newest time, to be used as now."""
    return posts.select(F.unix_millis(F.max(at)).alias("ms")).first().ms


def dedup_posts(posts: DataFrame, key: str = "id", order: str = "published_at", tie: str = "id", delta: str | None = None) -> DataFrame:
    """One row for each key: the first one's columns, the largest of each metric, the last delta. Repeats are merged before the shuffle."""
    metrics = [m for m in METRICS if m in posts.columns]
    rest = [c for c in posts.columns if c not in metrics and c not in (key, delta)]
    first = F.min_by(F.struct(*rest), F.struct(order, tie)).alias("first")
    made = [F.max(m).alias(m) for m in metrics] + ([F.max_by(delta, F.struct(order, tie)).alias(delta)] if delta else [])
    return posts.groupBy(key).agg(first, F.count("*").alias("seen"), *made).select(key, "first.*", *metrics, *([delta] if delta else []), "seen")


@dataclass(frozen=True)
class FeedQuery:
    since: str | None = None
    sources: tuple[str, ...] = ()
    topic: str | None = None
    entities: tuple[str, ...] = ()
    topics: tuple[str, ...] = ()
    order: str = "recent"
    limit: int | None = None
    offset: int = 0


def feed(posts: DataFrame, query: FeedQuery, bookmarked: DataFrame | None = None, read: DataFrame | None = None, watched: DataFrame | None = None) -> DataFrame:
    """Posts that meet all given conditions, in order. bookmarked and read have ids, watched has entities."""
    out = posts
    if query.since:
        out = out.filter(F.col("published_at") >= F.lit(query.since).cast("timestamp"))
    if query.sources:
        out = out.filter(F.col("source").isin(*query.sources))
    if query.topic is not None:
        out = out.filter(F.col("topic") == query.topic)
    wanted = lambda names: F.array(*map(F.lit, names))
    if query.entities:
        out = out.filter(F.arrays_overlap("entities", wanted(query.entities)))
    if query.topics:
        out = out.filter(F.arrays_overlap("tags", wanted(query.topics)) | F.arrays_overlap("entities", wanted(query.topics)))
    if bookmarked is not None:
        out = out.join(bookmarked.select("id"), "id", "left_semi")
    if read is not None:
        out = out.join(read.select("id"), "id", "left_anti")
    if watched is not None:
        about = out.select("id", F.explode("entities").alias("entity")).join(watched.select("entity"), "entity", "left_semi").select("id")
        out = out.join(about, "id", "left_semi")
    newest = [F.desc("published_at"), F.col("id")]
    out = out.orderBy(*([F.desc(engagement_key(posts.columns))] if query.order == "engaged" else []), *newest)
    out = out.offset(query.offset) if query.offset else out
    return out.limit(query.limit) if query.limit is not None else out


def search_words(spark: SparkSession, words: str) -> list[str]:
    """The distinct words of a query of two letters or more, accents and case aside."""
    tokens = F.array_distinct(F.filter(F.split(normalize_text(F.lit(words)), " "), lambda t: F.length(t) >= 2))
    return spark.range(1).select(tokens.alias("t")).first().t


def search(posts: DataFrame, words: str, text: Column, limit: int | None = None) -> DataFrame:
    """Posts in which all words of the query occur, accents and case aside, newest first; an empty query finds none.

    It reads every text; for many searches keep a search_index().
    """
    wanted = search_words(posts.sparkSession, words)
    padded = F.concat(F.lit(" "), normalize_text(text), F.lit(" "))
    # Bound in a lambda, the text is normalised once for all words.
    found = F.exists(F.array(padded), lambda t: reduce(lambda a, b: a & b, [F.contains(t, F.lit(f" {w} ")) for w in wanted])) if wanted else F.lit(False)
    out = posts.filter(found).orderBy(F.desc("published_at"), "id")
    return out.limit(limit) if limit is not None else out


def search_index(posts: DataFrame, text: Column) -> DataFrame:
    """(head, token, id, published_at), a row for each post and distinct word; write it with partitionBy("head")."""
    words = posts.select("id", "published_at", F.explode(F.array_distinct(F.split(normalize_text(text), " "))).alias("token")).filter(F.length("token") >= 2)
    return words.select(F.substring("token", 1, 2).alias("head"), "token", "id", "published_at")


def search_in(index: DataFrame, words: str, limit: int | None = None) -> DataFrame:
    """(id, published_at) of the posts of a search_index() that have all words, newest first; only the words' folders are read."""
    wanted = search_words(index.sparkSession, words)
    hits = index.filter(F.col("head").isin(*{w[:2] for w in wanted}) & F.col("token").isin(*wanted)) if wanted else index.limit(0)
    out = hits.groupBy("id", "published_at").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).drop("n").orderBy(F.desc("published_at"), "id")
    return out.limit(limit) if limit is not None else out


def entity_timeline(posts: DataFrame, entity: str, limit: int | None = None) -> DataFrame:
    """The posts that name an entity, newest first."""
    return feed(posts, FeedQuery(entities=(entity,), limit=limit))


def posts_of_list(posts: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Posts by or about the members (list, member) of user lists, with the list, each post once a list.

    A member is source:author, a handle with or without a leading @, or the slug of an entity, whatever the case.
    posts have a unique key, handle, and source, author_id and entities where they are known.
    """
    folded = lambda c: F.lower(F.regexp_replace(F.trim(c), "^@", ""))
    handle = folded(F.col("handle"))
    names = [F.array(handle)]
    if "source" in posts.columns:
        names.append(F.array(F.concat_ws(":", F.lower("source"), handle)))
    if "author_id" in posts.columns:
        names.append(F.array(F.lower("author_id")))
    if "entities" in posts.columns:
        names.append(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.lower(e)))
    named = members.select("list", F.regexp_replace(folded(F.col("member")), ":@", ":").alias("name_")).distinct()
    found = posts.select(key, F.explode(F.array_distinct(F.array_compact(F.concat(*names)))).alias("name_")).join(named, "name_").select("list", key).distinct()
    return posts.join(found, key)


def moment(ms: int) -> Column:
    """A time as a literal, so that filters on a bare column reach the files."""
    return F.timestamp_millis(F.lit(ms))


def retain(rows: DataFrame, now_ms: int, days: float = 30, at: str = "published_at") -> DataFrame:
    """Rows (posts, topics by last_seen, trend points by minute) that are not older than so many days."""
    return rows.filter(F.col(at) >= moment(now_ms - int(days * 86_400_000)))


def unread_counts(posts: DataFrame, read: DataFrame, since_ms: int = 0, key: str = "source") -> DataFrame:
    """(key, unread): posts from a time on that are not in read (id)."""
    fresh = posts.filter(F.col("published_at") >= moment(since_ms)).join(read.select("id"), "id", "left_anti")
    return fresh.groupBy(key).agg(F.count("*").alias("unread"))


def set_flags(flags: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A table of flagged keys after changes (key, at, on): the last change of each key decides; without any a key stays as it is."""
    last = changes.groupBy(key).agg(F.max_by("on", F.struct("at", "on")).alias("on"))
    kept = flags.select(key).distinct().join(last.select(key), key, "left_anti")
    return kept.union(last.filter("on").select(key))


def upsert_posts(stored: DataFrame, fresh: DataFrame, replace: tuple[str, ...] = ("title", "body", "topic")) -> DataFrame:
    """stored with fresh: known ids take the fresh values of `replace` and the larger metrics, new ids are added."""
    columns = stored.columns
    both = stored.select(F.struct(*columns).alias("old"), F.col("id").alias("old_id")).join(fresh.select(F.struct(*columns).alias("new"), F.col("id").alias("new_id")), F.col("old_id") == F.col("new_id"), "full_outer")

    def value(c: str) -> Column:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c in METRICS:
            return F.greatest(old, new)
        if c in replace:
            return F.when(F.col("new_id").isNotNull(), new).otherwise(old)
        return F.when(F.col("old_id").isNotNull(), old).otherwise(new)

    return both.select(*[value(c).alias(c) for c in columns])


def last_write_wins(stored: DataFrame, fresh: DataFrame, keys: list[str], at: str, first: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key; the columns in `first` keep their smallest value."""
    both = stored.unionByName(fresh)
    rest = [c for c in both.columns if c not in keys and c not in first]
    out = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("last"), *[F.min(c).alias(c) for c in first])
    return out.select(*keys, "last.*", *first).select(*both.columns)


def has_repeats(posts: DataFrame) -> bool:
    """Whether some id stands in several rows; only ids are read."""
    return not posts.groupBy("id").count().filter("count > 1").isEmpty()


def token_rows(posts: DataFrame, text: str = "body", min_length: int = 3) -> DataFrame:
    """(id, token, n): how often each token occurs in each post."""
    rows = posts.select("id", F.explode(token_counts(F.col(text), min_length)).alias("t")).select("id", "t.*")
    return rows.groupBy("id", "token").agg(F.sum("n").alias("n")) if has_repeats(posts) else rows


def post_tokens(posts: DataFrame, text: str = "body") -> DataFrame:
    """(id, t): one row for each post with its tokens (token, n), most frequent first, ties by token; the rows of a repeated id count together."""
    if not has_repeats(posts):
        return posts.select("id", token_counts(F.col(text)).alias("t"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "token", "n"))).alias("t")
    return token_rows(posts, text).groupBy("id").agg(ordered).select("id", F.transform("t", lambda t: F.struct(t["token"].alias("token"), t["n"].alias("n"))).alias("t"))


def top_tokens(posts: DataFrame, k: int = 5, text: str = "body") -> DataFrame:
    """The k most frequent tokens of each post; ties by token."""
    first = post_tokens(posts, text).select("id", F.posexplode(F.slice("t", 1, k)).alias("at", "t"))
    return first.select("id", "t.*", (F.col("at") + 1).alias("place"))
