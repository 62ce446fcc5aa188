"""Entities: whole-word alias matches by join, domains of addresses, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_text
from ..functions.urls import domain_suffixes, host_of
from ..functions.words import bucket_of, runs_of


def aliases_of(dictionary: DataFrame) -> DataFrame:
    """(alias, slug) of a dictionary (slug, aliases), normalised and distinct."""
    rows = dictionary.select("slug", F.explode("aliases").alias("a")).select("slug", normalize_text(F.col("a")).alias("alias"))
    return rows.filter(F.length("alias") > 0).distinct()


def extract_entities(posts: DataFrame, aliases: DataFrame, text: Column) -> DataFrame:
    """(id, entities): the sorted slugs whose alias stands as whole words in the text.

    Runs of as many words as some alias has are matched by an equi-join, so the dictionary may be of
    any size, and its aliases of any length. Runs that begin like no alias of their length, by a hash of bounded
    range, are left out beforehand.
    """
    words = F.split("alias", " ")
    lengths = aliases.groupBy(F.size(words).alias("n")).agg(F.collect_set(bucket_of(F.get(words, F.lit(0)))).alias("buckets"))
    starts = {r.n: frozenset(r.buckets) for r in lengths.collect()}  # a row for each length, of no more than BUCKETS numbers
    runs = posts.select("id", F.explode(runs_of(text, starts)).alias("alias"))
    return runs.join(aliases, "alias").groupBy("id").agg(F.array_sort(F.collect_set("slug")).alias("entities"))


def networks_of(pages: DataFrame, url: str, domains: DataFrame, key: str) -> DataFrame:
    """Each row of pages with a known domain (domain, network): the longest suffix of its host wins."""
    suffixes = pages.select(key, F.explode(domain_suffixes(host_of(F.col(url)))).alias("domain"))
    best = suffixes.join(domains, "domain").groupBy(key).agg(F.max_by(F.struct("domain", "network"), F.struct(F.length("domain"), F.col("domain"))).alias("m"))
    return best.select(key, "m.domain", "m.network")


def with_names(rows: DataFrame, names: DataFrame, slug: str = "entity") -> DataFrame:
    """Rows with the display name of their entity (slug, name); those without one keep the slug."""
    found = names.select(F.col("slug").alias(slug), "name")
    return rows.join(found, slug, "left").withColumn("name", F.coalesce("name", slug))


def listed_entities(names: DataFrame, text: str = "", watched_only: bool = False) -> DataFrame:
    """Entities (slug, name, watch) whose name has the text, whatever the case, watched first, then by name.

    With watched_only only watched ones, if any is watched at all.
    """
    out = names.filter(F.contains(F.lower("name"), F.lit(text.lower())))
    if watched_only and not names.filter("watch").isEmpty():
        out = out.filter("watch")
    return out.orderBy(F.desc("watch"), "name", "slug")


def translation_batches(texts: DataFrame, size: int = 16) -> DataFrame:
    """texts (text) with the number of their batch of `size`, numbered within 256 parts by hash, so that no task numbers all."""
    part = F.pmod(F.xxhash64("text"), F.lit(256))
    own = Window.partitionBy("part").orderBy("text")
    return texts.withColumn("part", part).withColumn("batch", F.floor((F.row_number().over(own) - 1) / size).cast("long"))


def untranslated(texts: DataFrame, cache: DataFrame, source_language: Column, target: str) -> DataFrame:
    """Distinct texts that the cache hasn't and that aren't in the target language already."""
    todo = texts.select("text", source_language.alias("lang")).filter(F.col("lang").isNull() | (F.col("lang") != target)).select("text").distinct()
    return todo.join(cache.select("text"), "text", "left_anti")
