"""Raw records of any source to posts in one select: identity, language, author, times, tags, entities, simhash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import detect_language, normalize_tags, slugify
from ..functions.urls import canonical_url, stable_id
from ..operators.entities import extract_entities
from ..operators.fingerprints import simhash
from ..operators.posts import METRICS

#: The handle of an author that isn't known.
UNKNOWN = "desconocido"


def text_option(options: Column, name: str, default: list[str] | None = None) -> Column:
    """An option of a map as a list: "a, b" gives [a, b]; a missing or blank one the default."""
    parts = F.filter(F.transform(F.split(options[name], ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(*map(F.lit, default or [])).cast("array<string>"))


def number_option(options: Column, name: str, default: float) -> Column:
    """An option of a map as a number; what is missing or no number gives the default."""
    return F.coalesce(options[name].try_cast("double"), F.lit(float(default)))


def author_of(source: Column, handle: Column, own_id: Column | None = None) -> Column:
    """(id, handle, source): the handle without a leading @, and an id from source and handle where there is none."""
    bare = F.regexp_replace(F.coalesce(handle, F.lit(UNKNOWN)), "^@", "")
    slug = F.coalesce(F.nullif(slugify(bare), F.lit("")), F.lit(UNKNOWN))
    made = F.concat(source, F.lit(":"), slug)
    return F.struct((F.coalesce(own_id, made) if own_id is not None else made).alias("id"), bare.alias("handle"), source.alias("source"))


def normalize_items(raw: DataFrame, now_ms: int, aliases: DataFrame | None = None, hashes: bool = True) -> DataFrame:
    """Posts of raw records (the columns of flatten.RAW), with entities and simhash.

    A record without a time gets now; missing metrics are null; a blank title or body is null. The title counts
    twice in the simhash. aliases: (alias, slug); without them, or without a match, entities are empty.
    """
    none = F.array().cast("array<string>")
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    at = F.timestamp_millis(F.lit(now_ms))
    text = F.trim(F.concat_ws("\n", blank("title"), blank("body")))
    positive = F.when(F.unix_millis("published_at") > 0, F.col("published_at"))
    url = canonical_url(F.col("url"))
    named = raw.withColumn("identity_", stable_id(F.col("source"), F.col("external_id"), F.col("url")))  # made once, told twice
    posts = named.select(
        F.col("identity_").alias("id"), "source", F.substring_index("identity_", ":", -1).alias("hash_id"), F.col("external_id"), url.alias("url"), blank("title").alias("title"), blank("body").alias("body"),
        F.coalesce("lang", detect_language(text)).alias("lang"), author_of(F.col("source"), F.col("author")).alias("author"), F.coalesce(positive, at).alias("published_at"), at.alias("ingested_at"),
        *[m for m in METRICS if m in raw.columns], normalize_tags(F.coalesce("tags", none)).alias("tags"), "origin", text.alias("text_"),
    )
    posts = posts.withColumn("external_id", F.coalesce(F.nullif("external_id", F.lit("")), "hash_id")).drop("hash_id")
    if aliases is not None:
        named = extract_entities(posts, aliases, F.col("text_"))
        posts = posts.join(named, "id", "left").withColumn("entities", F.coalesce("entities", none))
    else:
        posts = posts.withColumn("entities", none)
    if hashes:
        twice = posts.select("id", F.concat_ws(" ", "title", "title", "body").alias("body"))
        posts = posts.join(simhash(twice), "id", "left").withColumn("simhash", F.coalesce("simhash", F.lit(0).cast("long")))
    return posts.drop("text_")


def encode_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays and structs of the columns as JSON text, for archives that hold text."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def decode_json(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """JSON text of the columns as values of the kinds (column -> type); text that isn't JSON gives null."""
    return rows.withColumns({c: F.from_json(c, kind) for c, kind in kinds.items()})
