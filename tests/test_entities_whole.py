"""Aliases of any number of words match."""

from pyspark.sql import functions as F

from tidewatch.operators.entities import aliases_of, extract_entities


def test_long_aliases(spark):
    dictionary = spark.createDataFrame([("mit", ["Massachusetts Institute of Technology", "mit"]), ("six", ["one two three four five six"]), ("two", ["of technology"])], "slug string, aliases array<string>")
    posts = spark.createDataFrame([(1, "The Massachusetts Institute of Technology."), (2, "one two three four five six"), (3, "two three four five six"), (4, "summit"), (5, None), (6, "")], "id long, body string")
    got = {r.id: r.entities for r in extract_entities(posts, aliases_of(dictionary), F.col("body")).collect()}
    assert got == {1: ["mit", "two"], 2: ["six"]}
    assert extract_entities(posts, aliases_of(dictionary.limit(0)), F.col("body")).count() == 0
