"""What the training-data operators share: words, the working folder, components of a link graph."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..session import live_folders, load, release, release_since, shared_dir, written

__all__ = ["load", "shared_dir", "written", "release", "release_since", "live_folders", "free_name", "words_column", "words_of", "nth", "connected_components", "sha256_hex"]

#: A run of characters that separate words, after A-Z are lower-cased: all ASCII but 0-9 and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {ord(a): b for a, b in zip(UPPER, LOWER)}


def words_column(text: Column) -> Column:
    """Words of a text as array<string>; a null text has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS)
    return F.array_remove(parts, "")


def words_of(text: str | None) -> list[str]:
    """The same words in Python."""
    return _WORD.findall(text.translate(_FOLD)) if text else []


def nth(words: Column, start: Column, size: int) -> Column:
    """size words from the 0-based start."""
    return F.slice(words, (start + 1).cast("int"), F.lit(size))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to clash with no column, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(node, before, component) for edges (a, b) of one comparable type; component is the least node of it.

    Each round takes the least label among a node's neighbours, then follows labels one step
    (pointer jumping), and is written to the shared folder. It ends when no label changes.
    No edges give no rows; loops and repeated edges are allowed.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{label}-0")
    step = 0
    while True:
        step += 1
        known = labels.select(F.col("node").alias("b"), F.col("component").alias("seen"))
        least = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        nearer = labels.join(least, "node").select("node", F.col("component").alias("before"), F.least("component", "seen").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        after = nearer.join(jump, "component").select("node", "before", F.least("component", "further").alias("component"))
        after = written(after, f"{label}-{step}")
        release(labels)
        labels = after
        if after.filter("before <> component").isEmpty():
            release(both)
            return labels
