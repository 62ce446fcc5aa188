"""Posts join topics without their tokens going along with each pair or each round."""

import random
from datetime import timedelta

import pytest

from tests.test_candidates import NOW, POST, TOPIC
from tidewatch.operators import topics


def some(rng, n_posts=80, n_topics=30):
    words, things = [f"w{i}" for i in range(40)], ["e1", "e2", "e3", None]
    posts = [(f"p{i:03d}", NOW + timedelta(hours=rng.choice([0, 5, 9])), rng.sample(words, rng.randint(0, 20)), rng.sample(things, rng.randint(0, 3)), rng.getrandbits(63)) for i in range(n_posts)]
    known = [(f"t{i:03d}", NOW, rng.sample(words, rng.randint(0, 8)), rng.sample(things, rng.randint(0, 2)), rng.getrandbits(63)) for i in range(n_topics)]
    return posts, known


def plain(posts, known, join_at=0.45, most=24):
    overlap = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    out = set()
    for pid, at, tokens, own, h in posts:
        met = []
        for topic, seen, keywords, about, c in known:
            words, things = (set(tokens), set(keywords)), (set(own), set(about))
            weight = len(words[0] & words[1]) + 3 * len(things[0] & things[1])
            score = round(0.4 * overlap(*words) + 0.25 * (1 - (h ^ c).bit_count() / 64) + 0.35 * overlap(*things), 9)
            if weight:
                met.append((-weight, topic, at - seen <= timedelta(hours=6), score))
        best = [(-score, topic) for _, topic, alive, score in sorted(met)[:most] if alive and score >= join_at]
        out.add((pid, min(best)[1], -min(best)[0]) if best else (pid, None, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_carry_no_tokens(spark, seed):
    posts, known = some(random.Random(seed))
    made = topics.assign_topics(spark.createDataFrame(posts, POST), spark.createDataFrame(known, TOPIC))
    got = {tuple(r) for r in made.collect()}
    assert got == plain(posts, known) and 20 < sum(r[1] is not None for r in got)
    assert "array_intersect" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_many_topics_of_a_term_and_repeated_ids(spark):
    posts, known = some(random.Random(3), 40, 400)
    held = spark.createDataFrame(posts, POST)
    assert {tuple(r) for r in topics.assign_topics(held, spark.createDataFrame(known, TOPIC)).collect()} == plain(posts, known)
    few = known[:5]
    twice = topics.assign_topics(held.union(held), spark.createDataFrame(few, TOPIC)).collect()
    assert len(twice) == 2 * len(posts) and {tuple(r) for r in twice} == plain(posts, few)


def test_rounds_write_no_tokens(spark, monkeypatch):
    posts, _ = some(random.Random(4))
    seen, write = {}, topics.written
    monkeypatch.setattr(topics, "written", lambda df, label: seen.setdefault(label, df.columns) and write(df, label))
    rows = spark.createDataFrame([(*p[:4], p[4], sorted(p[2])[:5]) for p in posts], POST + ", keywords array<string>")
    opened = topics.open_topics(rows)
    assert {r.id for r in opened.collect()} == {p[0] for p in posts} and opened.count() == len(posts)
    assert "left-0" in seen and not [label for label, columns in seen.items() if "tokens" in columns]
