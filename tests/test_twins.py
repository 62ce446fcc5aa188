"""Twins in small, large and very large blocks against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import topics

SCHEMA = "topic string, keywords array<string>, entities array<string>, centroid long"


def all_pairs(rows, merge_at):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    sets = [(t, set(k or ()), set(e or ()), c & (2**64 - 1)) for t, k, e, c in rows]
    for i, (t, k, e, c) in enumerate(sets):
        for u, l, f, d in sets[:i]:
            if round(0.4 * overlap(k, l) + 0.25 * (1 - (c ^ d).bit_count() / 64) + 0.35 * overlap(e, f), 9) >= merge_at:
                x, y = sorted((find(t), find(u)))
                root[y] = x
    return {t: find(t) for t, *_ in sets}


def some_topics(seed, n=260):
    """Topics with few words and entities, and centroids near some of few centres."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        for _ in range(rng.choice((0, 1, 2, 6, 12, 30))):
            c ^= 1 << rng.randrange(64)
        words = rng.sample([f"w{j}" for j in range(rng.choice((3, 12, 40)))], rng.randint(0, 3)) + [f"x{rng.randrange(60)}" for _ in range(rng.randint(0, 6))]
        rows.append((f"t{i:04d}", (["k"] if rng.random() < 0.7 else []) + list(dict.fromkeys(words))[:7], rng.choice(([], ["e"], ["e"], ["e", "f"], ["g"])), c - 2**64 if c >= 2**63 else c))
    return rows + [("z1", None, None, 0), ("z2", None, None, 0), ("z3", ["q"], None, 5), ("z4", ["q"], None, 5), ("z5", [], ["e"], 5), ("z6", [], ["e"], 5)]


@pytest.mark.parametrize(("seed", "large", "merge_at"), [(1, 256, 0.62), (2, 0, 0.62), (3, 5, 0.62), (4, 0, 0.7), (5, 0, 0.61)])
def test_against_all_pairs(spark, seed, large, merge_at):
    rows = some_topics(seed)
    got = {r.topic: r.merged for r in topics.merge_topics(spark.createDataFrame(rows, SCHEMA).repartition(5), merge_at, large).collect()}
    want = all_pairs(rows, merge_at)
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_twenty_thousand_topics_in_one_block(spark):
    n = 20_000
    others = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(5000)).cast("string")))
    apart = spark.range(n).select(F.format_string("a%05d", "id").alias("topic"), F.concat(F.array(F.lit("k")), others).alias("keywords"), F.array(F.lit("e")).alias("entities"), F.xxhash64("id").alias("centroid"))
    same = spark.range(n).select(F.format_string("b%05d", "id").alias("topic"), F.array(F.lit("k"), F.lit("l")).alias("keywords"), F.array(F.lit("e")).alias("entities"), F.xxhash64("id").alias("centroid"))
    nodes = apart.withColumns({"class": F.col("topic"), "node": F.col("topic")})
    of_classes, of_nodes = topics._candidates(nodes, 0.62, topics.LARGE_BLOCK)
    assert of_classes.count() + of_nodes.count() < n * n / 2 / 50
    merged = topics.merge_topics(apart.union(same))
    assert merged.filter("topic LIKE 'b%'").select("merged").distinct().count() == 1 and merged.count() == 2 * n
