"""Candidate topics: equal to all pairs whatever the lengths of the posting lists, and far fewer pairs."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tidewatch.operators import topics

NOW = datetime(2025, 10, 9, 8, 0, tzinfo=timezone.utc)
POST = "id string, published_at timestamp, tokens array<string>, entities array<string>, simhash long"
TOPIC = "topic string, last_seen timestamp, keywords array<string>, entities array<string>, centroid long"


def made(spark, rng, n_posts, n_topics, words, entities, common=0.5):
    pick = lambda pool, k: rng.sample(pool, min(k, len(pool)))
    often = words[:5]
    terms = lambda k: list(dict.fromkeys([w for w in often if rng.random() < common] + pick(words, k)))
    posts = [(f"p{i:04d}", NOW, terms(rng.randint(0, 12)), pick(entities, rng.randint(0, 2)), 0) for i in range(n_posts)]
    known = [(f"t{i:05d}", NOW - timedelta(hours=rng.choice([0, 1, 9])), terms(rng.randint(0, 6))[:8], pick(entities, rng.randint(0, 3)), 0) for i in range(n_topics)]
    return posts, known, spark.createDataFrame(posts, POST), spark.createDataFrame(known, TOPIC)


def plain(posts, known, most):
    out = set()
    for pid, at, tokens, own, _ in posts:
        weights = []
        for topic, seen, keywords, about, _ in known:
            weight = len(set(tokens) & set(keywords)) + 3 * len(set(own) & set(about))
            if weight:
                weights.append((-weight, topic, at - seen <= timedelta(hours=6)))
        out |= {(pid, topic, -w) for w, topic, alive in sorted(weights)[:most] if alive}
    return out


@pytest.mark.parametrize("seed,look", [(1, 64), (2, 3), (3, 1)])
def test_candidates_against_all_pairs(spark, seed, look):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    posts, known, p, t = made(spark, rng, 60, 400, words, ["e1", "e2", "e3", "e4"])
    for most in (3, 24):
        got = {tuple(r) for r in topics.candidate_topics(p, t, most=most, look=look).collect()}
        assert got == plain(posts, known, most)


def test_common_terms_make_few_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    posts, known, p, t = made(spark, rng, 100, 4000, words, [f"e{i}" for i in range(500)])
    all_pairs = sum(bool(set(x[2]) & set(y[2]) or set(x[3]) & set(y[3])) for x in posts for y in known)
    few = topics.candidate_pairs(p, t).count()
    assert {tuple(r) for r in topics.candidate_topics(p, t).collect()} == plain(posts, known, 24)
    assert few < 0.3 * all_pairs, (few, all_pairs)


def test_nothing_to_meet(spark):
    _, _, p, t = made(spark, random.Random(1), 3, 3, ["a", "b"], ["e"])
    assert topics.candidate_topics(p.limit(0), t).count() == 0 and topics.candidate_topics(p, t.limit(0)).count() == 0
