"""Outcomes of actions on several targets, watch terms, and the archive's copies and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def action_outcomes(targets: DataFrame, action: str = "action", status: str = "status") -> DataFrame:
    """How each action's targets ended; it succeeds if one did, fails if none did, and is open while one is."""
    n = lambda s: F.count_if(F.coalesce(F.col(status) == s, F.lit(False)))
    names = ("SUCCESS", "FAILED", "SKIPPED", "PENDING", "RUNNING")
    out = targets.groupBy(F.col(action)).agg(F.count("*").alias("total"), *[n(s).alias(s.lower()) for s in names])
    overall = F.when(F.col("pending") + F.col("running") > 0, "OPEN").when(F.col("success") > 0, "SUCCESS").otherwise("FAILED")
    return out.withColumn("partial", (F.col("success") > 0) & (F.col("failed") > 0)).withColumn("overall", overall)


def watch_terms(queries: DataFrame, watchlist: DataFrame, entities: DataFrame, most: int = 40) -> DataFrame:
    """Distinct terms of saved queries (comma-separated), watched slugs and watched entities; the first `most` in that order.

    Terms of the first two need three letters. The limit is the feature: a live source takes so many.
    """
    words = queries.select(F.lit(1).alias("kind"), F.explode(F.split(F.lower("query"), ",")).alias("term")).withColumn("term", F.trim("term")).filter("length(term) >= 3")
    slugs = watchlist.filter("length(slug) >= 3").select(F.lit(2).alias("kind"), F.replace("slug", F.lit("-"), F.lit(" ")).alias("term"))
    names = entities.filter("watch").select(F.lit(3).alias("kind"), F.explode(F.array(F.lower("name"), F.replace("slug", F.lit("-"), F.lit(" ")))).alias("term"))
    return words.union(slugs).union(names).groupBy("term").agg(F.min("kind").alias("kind")).orderBy("kind", "term").limit(most)


def write_snapshot(tables: dict[str, DataFrame], folder: str, version: int) -> None:
    """Each table as Parquet below folder/version=N; a version that is there is not replaced."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/version={version}/{name}")


def read_snapshot(spark, folder: str, version: int, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/version={version}/{name}") for name in names}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table; no table is an error."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out
