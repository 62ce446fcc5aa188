"""Packing: ids by the library, places by hand, plans against a lower bound and against plain best fit."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import packing, registry
from tidewatch.llm.common import load

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    found.no_truncation()
    found.no_padding()
    return found


def little_endian(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def places_hold(rows, capacity):
    """Each sequence is filled from 0 without a gap, up to capacity at most."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(sequences)


def test_op13_by_library(spark, library):
    rows = registry.QUERIES["op13_packing"](spark, SF).collect()
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for r in load(spark, SF, "documents").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, piece] = (at, len(part), zlib.crc32(little_endian(part)))
    assert got == want and len(rows) == len(want)
    assert places_hold(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 1


EDGES = [(1, "Straße, <|endoftext|> naïve don't 1234!!"), (1, "Straße, <|endoftext|> naïve don't 1234!!"), (2, None), (3, ""), (None, " \t\n "), (4, "é \x1c \xa0 x y"), (5, " ".join(f"w{i}" for i in range(30_000))), (6, "<|ENDOFTEXT|> Ünder... ?!. a.b ..."), (7, "日本語 İstanbul ǅ"), (8, "wörd? wörd! WÖRD.")]


def test_edges(spark, library):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("key", F.lit("own")).withColumn("Piece", F.lit("own")).withColumn("a.b", F.lit("own"))
    rows = packing.pack_documents(docs, with_ids=True).collect()
    places_hold(rows, 2048)
    whole = Counter()
    pieces = sorted(rows, key=lambda r: (r.doc_id or 0, r.piece))
    texts = defaultdict(list)
    for r in pieces:
        texts[r.doc_id].append(bytes(r.ids))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for key, text in EDGES:
        whole[key] += 1
        assert b"".join(texts[key]) == b"".join([little_endian([*library.encode(text or "", add_special_tokens=False).ids, 0])] * len([k for k, _ in EDGES if k == key])), key
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame([(i, "some words here " * i) for i in range(40)], "doc_id long, text string")
    packed = packing.pack_documents(docs, capacity=64, with_ids=True).cache()
    places_hold(packed.collect(), 64)
    made = {r.sequence_id: r for r in packing.packed_sequences(packed).collect()}
    for r in packed.collect():
        ids = made[r.sequence_id].ids[r.offset : r.offset + r.length]
        assert little_endian(ids) == bytes(r.ids) and r.offset in made[r.sequence_id].starts


def exact(counts, capacity):
    """The least number of sequences, by trying all ways; for a handful of pieces."""
    pieces = sorted(counts.elements(), reverse=True)

    def least(at, rooms):
        if at == len(pieces):
            return len(rooms)
        found = least(at + 1, (*rooms, capacity - pieces[at]))
        for k in {r: i for i, r in enumerate(rooms) if r >= pieces[at]}.values():
            found = min(found, least(at + 1, (*rooms[:k], rooms[k] - pieces[at], *rooms[k + 1 :])))
        return found

    return least(0, ())


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 20, 64, 2048])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 8)))
    plan = packing.plan_sequences(counts, capacity)
    used = Counter()
    for times, lengths in plan:
        assert times > 0 and 0 < sum(lengths) <= capacity
        used.update({x: n * times for x, n in Counter(lengths).items()})
    assert used == counts
    assert sum(times for times, _ in plan) <= exact(counts, capacity) + 1


def test_exact_complements_fill_whole_sequences():
    # Best fit alone would put 5 with 4 and need a third sequence.
    counts = Counter({5: 1, 4: 1, 3: 3, 2: 1})
    assert sorted(sum(x) * n for n, x in packing.plan_sequences(counts, 10)) == [10, 10]


def test_large_counts_make_small_plans():
    rng = random.Random(7)
    counts = {x: rng.randint(0, 10**9) for x in range(1, 2049)}
    plan = packing.plan_sequences(counts)
    assert len(plan) < 10_000 and sum(n for n, _ in plan) <= 1.05 * sum(x * n for x, n in counts.items()) / 2048
    places = packing.Places(plan)
    assert len(places.key) < 100_000
