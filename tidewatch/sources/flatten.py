"""Landed payloads of public feeds, flattened to one schema of raw posts.

Each function takes the frame of one source's payloads, read with the schema given here, and
returns RAW columns. Bad records stay in _corrupt and are told apart by `bad_records`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.text import squeeze_tags, strip_html

RAW = (
    "source string, external_id string, url string, title string, body string, lang string, author string, published_at timestamp, "
    "likes long, replies long, reposts long, score long, comments long, stars long, tags array<string>, origin string"
)
SCHEMAS = {
    "hackernews": "id long, type string, by string, title string, text string, url string, time long, score long, descendants long, deleted boolean, dead boolean, _corrupt string",
    "bluesky": "posts array<struct<uri:string,author:struct<did:string,handle:string>,record:struct<text:string,createdAt:string,langs:array<string>>,likeCount:long,replyCount:long,repostCount:long>>, _corrupt string",
    "reddit": "data struct<children:array<struct<data:struct<id:string,title:string,selftext:string,permalink:string,author:string,subreddit:string,link_flair_text:string,created_utc:double,score:long,num_comments:long,over_18:boolean>>>>, _corrupt string",
    "mastodon": "id string, url string, content string, language string, created_at string, account struct<acct:string>, favourites_count long, reblogs_count long, replies_count long, tags array<struct<name:string>>, instance string, _corrupt string",
    "github": "items array<struct<id:long,full_name:string,html_url:string,description:string,language:string,topics:array<string>,stargazers_count:long,open_issues_count:long,created_at:string,owner:struct<login:string>>>, _corrupt string",
    "releases": "repo string, tag_name string, name string, body string, html_url string, prerelease boolean, published_at string, author struct<login:string>, _corrupt string",
    "feeds": "feed_url string, value string, _corrupt string",
}


def _raw(frame: DataFrame, source: str, **columns: Column) -> DataFrame:
    kinds = dict(c.strip().split(" ", 1) for c in RAW.split(", "))
    columns["source"] = F.lit(source)
    return frame.select(*[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def _moment(seconds: Column) -> Column:
    """A time of seconds since 1970; null outside the years 1 to 9999."""
    inside = seconds.between(-62_135_596_800, 253_402_300_799)
    return F.timestamp_millis((F.when(inside, seconds) * 1000).cast("long"))


def hackernews(items: DataFrame, site: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    live = items.filter(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)) & F.col("type").isin("story", "job"))
    return _raw(
        live, "hackernews", external_id=F.col("id"), url=F.coalesce("url", F.concat(F.lit(site), F.col("id").cast("string"))), title=F.col("title"), body=strip_html(F.col("text")),
        author=F.col("by"), published_at=_moment(F.col("time")), score=F.col("score"), comments=F.col("descendants"), origin=F.lit("api"),
    )


def bluesky(pages: DataFrame) -> DataFrame:
    p = pages.select(F.explode("posts").alias("p")).select("p.*")
    key = F.element_at(F.split("uri", "/"), -1)
    who = F.coalesce("author.handle", "author.did")
    return _raw(
        p, "bluesky", external_id=F.col("uri"), url=F.concat(F.lit("https://bsky.app/profile/"), who, F.lit("/post/"), key), body=F.substring("record.text", 1, 1000), lang=F.get("record.langs", F.lit(0)),
        author=who, published_at=F.try_to_timestamp("record.createdAt"), likes=F.coalesce("likeCount", F.lit(0)), replies=F.coalesce("replyCount", F.lit(0)), reposts=F.coalesce("repostCount", F.lit(0)), origin=F.lit("search"),
    )


def reddit(listings: DataFrame) -> DataFrame:
    p = listings.select(F.explode("data.children").alias("c")).select("c.data.*").filter(~F.coalesce("over_18", F.lit(False)))
    return _raw(
        p, "reddit", external_id=F.col("id"), url=F.concat(F.lit("https://www.reddit.com"), "permalink"), title=F.col("title"), body=F.substring("selftext", 1, 1500), author=F.col("author"),
        published_at=_moment(F.col("created_utc")), score=F.col("score"), comments=F.col("num_comments"), tags=F.array_compact(F.array("subreddit", "link_flair_text")), origin=F.col("subreddit"),
    )


def mastodon(statuses: DataFrame) -> DataFrame:
    tags = F.concat(F.array(F.lit("mastodon")), F.transform(F.coalesce("tags", F.array().cast("array<struct<name:string>>")), lambda t: t["name"]), F.array("instance"))
    return _raw(
        statuses, "mastodon", external_id=F.col("id"), url=F.col("url"), body=squeeze_tags(F.col("content")), lang=F.col("language"), author=F.col("account.acct"), published_at=F.try_to_timestamp("created_at"),
        likes=F.col("favourites_count"), reposts=F.col("reblogs_count"), replies=F.col("replies_count"), tags=F.array_compact(tags), origin=F.col("instance"),
    )


def github(pages: DataFrame, created_since: str | None = None) -> DataFrame:
    p = pages.select(F.explode("items").alias("r")).select("r.*")
    if created_since:
        p = p.filter(F.try_to_timestamp("created_at") >= F.lit(created_since).cast("timestamp"))
    tags = F.array_compact(F.concat(F.array(F.lower("language")), F.slice(F.coalesce("topics", F.array().cast("array<string>")), 1, 4)))
    return _raw(
        p, "github", external_id=F.col("id"), url=F.col("html_url"), title=F.col("full_name"), body=F.substring("description", 1, 1200), author=F.col("owner.login"), published_at=F.try_to_timestamp("created_at"),
        stars=F.col("stargazers_count"), comments=F.col("open_issues_count"), tags=tags, origin=F.lit("search"),
    )


def releases(rows: DataFrame) -> DataFrame:
    r = rows.filter(~F.coalesce("prerelease", F.lit(False)))
    return _raw(
        r, "github", external_id=F.concat(F.lit("release:"), "repo", F.lit("@"), "tag_name"), url=F.col("html_url"), title=F.concat_ws(" ", "repo", "tag_name"), body=F.substring(F.coalesce("body", "name"), 1, 1200),
        author=F.col("author.login"), published_at=F.try_to_timestamp("published_at"), tags=F.array(F.lit("release")), origin=F.col("repo"),
    )


def feed_time(text: Column) -> Column:
    """Dates of both feed dialects: ISO, or day names and zones of mail headers."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


RSS_ITEM = "title string, link string, guid string, description string, pubDate string, category array<string>, creator string"
ATOM_ENTRY = "title string, id string, summary string, content string, published string, updated string, link array<struct<_href:string,_rel:string>>, category array<struct<_term:string>>, author struct<name:string>"


def rss(items: DataFrame, feed_url: str | Column, now: Column) -> DataFrame:
    """Items read by the XML source with rowTag item."""
    return _raw(
        items, "rss", external_id=F.coalesce("guid", "link"), url=F.trim("link"), title=F.trim("title"), body=squeeze_tags(F.col("description"), 2000), author=F.col("creator"),
        published_at=F.coalesce(feed_time(F.col("pubDate")), now), tags=F.coalesce("category", F.array().cast("array<string>")), origin=F.lit(feed_url),
    )


def atom(entries: DataFrame, feed_url: str | Column, now: Column) -> DataFrame:
    """Entries read by the XML source with rowTag entry; the alternate link counts."""
    link = F.get(F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), F.lit(0))["_href"]
    return _raw(
        entries, "rss", external_id=F.coalesce("id", link), url=link, title=F.trim("title"), body=squeeze_tags(F.coalesce("content", "summary"), 2000), author=F.col("author.name"),
        published_at=F.coalesce(feed_time(F.coalesce("published", "updated")), now), tags=F.transform(F.coalesce("category", F.array().cast("array<struct<_term:string>>")), lambda c: c["_term"]), origin=F.lit(feed_url),
    )


def _struct(columns: str) -> str:
    """A struct type of columns written as name type, name type."""
    return "struct<" + StructType.fromDDL(columns).simpleString()[7:]


#: Entries that a feed gives at most, the first ones of its document.
FEED_LIMIT = 25


def feeds(documents: DataFrame, now: Column | None = None, most: int = FEED_LIMIT) -> DataFrame:
    """Whole feeds (feed_url, value: the XML) of either dialect, the first `most` entries of each; entries without a time get now.

    A document that is no feed gives no posts.
    """
    schema = f"channel struct<item:array<{_struct(RSS_ITEM)}>>, entry array<{_struct(ATOM_ENTRY)}>"
    at = now if now is not None else F.lit(None).cast("timestamp")
    read = documents.select("feed_url", F.from_xml("value", schema, {"mode": "PERMISSIVE", "attributePrefix": "_", "ignoreNamespace": "true"}).alias("f"))
    entries = lambda c: read.select("feed_url", F.explode(F.slice(c, 1, most)).alias("e")).select("feed_url", "e.*")
    both = rss(entries(F.col("f.channel.item")), F.col("feed_url"), at).unionByName(atom(entries(F.col("f.entry")), F.col("feed_url"), at))
    return both.filter("trim(url) <> ''")


#: name -> flattening function; further sources are registered by adding to it.
CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"hackernews": hackernews, "bluesky": bluesky, "reddit": reddit, "mastodon": mastodon, "github": github, "releases": releases, "feeds": feeds}


def read_landed(spark: SparkSession, source: str, path: str) -> DataFrame:
    """Payloads of a source as landed, a JSON document a line; what doesn't parse is kept in _corrupt."""
    return spark.read.schema(SCHEMAS[source]).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def bad_records(landed: DataFrame, source: str) -> DataFrame:
    """(source, record) of the payloads that didn't parse."""
    return landed.filter(F.col("_corrupt").isNotNull()).select(F.lit(source).alias("source"), F.col("_corrupt").alias("record"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_ranked_ids(lists: DataFrame, limit: int) -> DataFrame:
    """Ids of ranked lists (rank, ids array), each at its first place, the best `limit`."""
    rows = lists.select("rank", F.posexplode("ids").alias("pos", "id"))
    return rows.groupBy("id").agg(F.min(F.struct("rank", "pos")).alias("at")).orderBy("at").limit(limit).select("id")


def ingest_report(fresh: DataFrame, stored: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: fetched, inserted and duplicate posts, errors, and the topics touched (sorted) if fresh has a topic."""
    known = fresh.select("id").join(stored.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("known"))
    touched = F.array_sort(F.collect_set("topic")) if "topic" in fresh.columns else F.array().cast("array<string>")
    total = fresh.agg(F.count("*").alias("fetched"), F.count_distinct("id").alias("ids"), touched.alias("touched"))
    new = fresh.select("id").distinct().join(stored.select("id"), "id", "left_anti").agg(F.count("*").alias("inserted"))
    failed = errors.agg(F.count("*").alias("errors")) if errors is not None else fresh.sparkSession.range(1).select(F.lit(0).alias("errors"))
    made = total.crossJoin(new).crossJoin(known).crossJoin(failed)  # one row each
    return made.select("fetched", "inserted", (F.col("fetched") - F.col("inserted")).alias("duplicates"), "errors", "touched")


def ingest_totals(reports: DataFrame) -> DataFrame:
    """One row: the sums of the reports of several sources, and all topics they touched."""
    sums = [F.sum(c).alias(c) for c in ("fetched", "inserted", "duplicates", "errors")]
    return reports.agg(*sums, F.array_sort(F.array_distinct(F.flatten(F.collect_list("touched")))).alias("touched"))
