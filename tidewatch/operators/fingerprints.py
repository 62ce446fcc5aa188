"""64-bit simhash of texts, the majority centroid of a topic, and keyword ranking by rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.words import token_counts
from .posts import post_tokens, token_rows


def assembled(votes: list[Column]) -> Column:
    """64 bits, the lowest first, as one long."""
    out = F.lit(0).cast("long")
    for bit, vote in enumerate(votes):
        out = out.bitwiseOR(F.shiftleft(vote.cast("long"), bit))
    return out


def simhash(posts: DataFrame, text: str = "body") -> DataFrame:
    """(id, simhash) of each post with a token. The rows of an id add up their votes, so no tokens are shuffled."""
    rows = posts.select("id", token_counts(F.col(text), votes=True, counts=False).alias("c")).select("id", "c.n", "c.votes")
    return summed_votes(rows).filter("n > 0").select("id", simhash_of("n", "votes").alias("simhash"))


def summed_votes(rows: DataFrame) -> DataFrame:
    """rows (id, n, votes) with the sums of each id; two bits are counted in one sum, each in a half of a long."""
    summed = rows.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(F.get("votes", F.lit(b))).alias(f"v{b}") for b in range(32)])
    return summed.select("id", "n", F.array(*[f"v{b}" for b in range(32)]).alias("votes"))


def simhash_of(n: str, votes: str) -> Column:
    """The bits that more than half of n tokens have."""
    v = [F.get(votes, F.lit(b)) for b in range(32)]
    ones = [x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in v] + [F.shiftrightunsigned(x, 32) for x in v]
    return assembled([2 * x > F.col(n) for x in ones])


def centroids(members: DataFrame) -> DataFrame:
    """(topic, centroid) for rows of (topic, simhash): a bit is set where at least half have it."""
    ones = [F.sum(F.bit_get("simhash", F.lit(b)).cast("long")).alias(f"v{b}") for b in range(64)]
    summed = members.groupBy("topic").agg(F.count("*").alias("n"), *ones)
    return summed.select("topic", assembled([F.col(f"v{b}") * 2 >= F.col("n") for b in range(64)]).alias("centroid"))


def top_keywords(posts: DataFrame, k: int = 6, text: str = "body", corpus: DataFrame | None = None) -> DataFrame:
    """The k tokens of each post that are frequent in it and rare in the corpus; ties by token.

    corpus: (token, df) of another corpus; tokens that it hasn't count as never seen there. Without it, posts are the corpus.
    However common or rare its tokens are, k of a post score more than some others of it can; these take no part in the join.
    """
    least = F.get(F.sort_array(F.transform("t", lambda t: 0.35 * t["n"] + F.length(t["token"]) * 0.02), asc=False), F.lit(k - 1))
    most = lambda t: t["n"] + F.length(t["token"]) * 0.02  # noqa: E731  of a token that the corpus never had
    rows = post_tokens(posts, text).withColumn("least", F.coalesce(least, F.lit(0.0)) - 1e-6)
    counts = rows.select("id", F.explode("t").alias("t"), "least").filter(most(F.col("t")) >= F.col("least")).select("id", "t.*")
    if corpus is None:
        corpus = token_rows(posts, text).groupBy("token").agg(F.count("*").alias("df"))
    else:
        counts, corpus = counts.join(corpus, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))), None
    score = F.col("n") * (0.35 + 0.65 / (1 + F.log1p("df"))) + F.length("token") * 0.02
    scored = (counts.join(corpus, "token") if corpus is not None else counts).withColumn("score", F.round(score, 9))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "token"))
    return scored.withColumn("place", place).filter(F.col("place") <= k).select("id", "token", "n", "df", "score", "place")
