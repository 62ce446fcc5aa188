"""Vector codes: trees against all distances, the operator against plain Python, and odd vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import vector_codes
from tidewatch.llm.vector_codes import Gnat


def brute(entries, queries):
    """Lowest index of the least squared distance, in Python's whole numbers."""
    out = []
    for q in queries.tolist():
        squares = [sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in entries.tolist()]
        out.append((squares.index(min(squares)), min(squares)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_trees_find_the_lowest_of_the_nearest(seed):
    rng = np.random.default_rng(seed)
    spread = [2, 3, 40, 100_000][seed % 4]  # narrow ones are full of ties and equal entries
    entries = rng.integers(-spread, spread, (rng.integers(1, 80), rng.integers(1, 5)))
    queries = rng.integers(-spread, spread, (300, entries.shape[1]))
    tree = Gnat(entries)
    got = list(zip(*[x.tolist() for x in tree.nearest(queries)]))
    assert got == brute(entries, queries)


def test_trees_of_large_numbers():
    rng = random.Random(3)
    entries = np.array([[rng.randint(-(10**40), 10**40) for _ in range(3)] for _ in range(40)], dtype=object)
    queries = np.array([[rng.randint(-(10**40), 10**40) for _ in range(3)] for _ in range(50)] + entries.tolist(), dtype=object)
    assert list(zip(*[x.tolist() for x in Gnat(entries).nearest(queries)])) == brute(entries, queries)


def test_ranges_rule_out_subtrees():
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(-30, 30, (16, 4)) + 2000 * rng.integers(-3, 4, 4) for _ in range(4)])
    queries = entries[rng.integers(0, 64, 1000)] + rng.integers(-20, 20, (1000, 4))
    tree = Gnat(entries)
    assert [x for x, _ in brute(entries, queries)] == tree.nearest(queries)[0].tolist()
    assert tree.compared < 0.6 * 64 * len(queries)


def plain(rows, parts, k, rounds):
    """The contract word by word; rows of (id, vector, label) with whole ids."""
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: r[0])
    size = len(fine[0][1]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in fine[:k]] for p in range(parts)]
    nearest = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in fine:
                groups.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for e, own in groups.items():
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out, labels = {}, {}
    for i, v, label in fine:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = ["".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label]
        labels[label] = labels.get(label, 0) + out[i][1]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: (c, e, labels[label]) for i, (c, e, label) in out.items()}, digest


SCHEMA = "vec_id long, embedding array<float>, label int"


def apply(vectors, **how):
    books = vector_codes.train_codebooks(vectors, **how)
    return vector_codes.with_label_errors(vector_codes.encode_vectors(vectors, books)), books


def test_odd_vectors(spark):
    rng = random.Random(5)
    numbers = lambda: [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]
    rows = [(i, numbers(), rng.choice([1, 2, None])) for i in range(60)]
    rows += [(100, None, 1), (101, [1.0, None, *numbers()[2:]], 1), (102, [float("nan"), *numbers()[1:]], 2), (103, [float("inf"), *numbers()[1:]], 2), (104, [-float("inf")] * 8, None)]
    rows += [(105, [0.0] * 8, 9), (106, [float(np.float32(3e38))] * 8, 8), (107, [float(np.float32(-1e20))] * 8, 8), (-5, [0.0] * 8, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got, books = apply(frame, parts=4, entries=8)
    want, digest = plain(rows, 4, 8, 2)
    want = {i: tuple(min(x, 2**63 - 1) if isinstance(x, int) else x for x in w) for i, w in want.items()}
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got.collect()} == want and books.digest() == digest


def test_fewer_vectors_than_entries_repeats_and_other_dimensions(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [5.0, -2.0], None), (2, [], 3), (3, [1.0], 3)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for c in ("null", "own", "Code", "made", "a.b", "v", "total"):
        frame = frame.withColumn(c, F.lit("x"))
    got, books = apply(frame, parts=2)
    found = got.collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in found) == [(0, "0202", 0, 0), (1, "0000", 0, 0), (1, "0000", 0, 0)]
    assert all(r["a.b"] == "x" and r["total"] == "x" for r in found)
    assert [r.decoded for r in vector_codes.decode_vectors(got.filter("vec_id = 1"), books).collect()] == [[256, 512]] * 2


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, None, 1)], SCHEMA)
    for some in (frame, frame.limit(0)):
        got, books = apply(some)
        assert got.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
        assert vector_codes.decode_vectors(got, books).count() == 0
