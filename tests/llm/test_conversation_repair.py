"""Conversation repair: cells against full CYK and against all edits, the operator against a plain version, long conversations in ranges."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidewatch.llm import conversation_repair as repair, registry

KINDS = "dsuaxSUAX"


def all_edits(kinds):
    """The least (cost, audit) over all edits of up to four rows, with up to three insertions anywhere."""
    best = None
    options = []
    for k in kinds:
        more = 5 if k.isupper() else 0
        options.append([(2, "D", "")] + ([] if k == "d" else [(more, "K", k.lower()), (1 + more, "R", "u"), (1 + more, "R", "a")]))
    for chosen in itertools.product(*options):
        for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(kinds) + 1), n) for n in range(4)):
            for letters in itertools.product("ua", repeat=len(places)):
                row, audit, cost = "", "", 0
                for i in range(len(kinds) + 1):
                    for place, letter in zip(places, letters):
                        if place == i:
                            row, audit, cost = row + letter, audit + "I", cost + 5
                    if i < len(kinds):
                        row, audit, cost = row + chosen[i][2], audit + chosen[i][1], cost + chosen[i][0]
                if re.fullmatch("(s?(ua)+)?", row) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


@pytest.mark.parametrize("n", range(4))
def test_cells_against_all_edits(n):
    spans = ["".join(k) for k in itertools.product(KINDS, repeat=n)]
    rng = random.Random(n)
    for kinds in spans if n < 3 else rng.sample(spans, 60):
        assert repair.cheapest(repair.span_cell(kinds)) == all_edits(kinds), kinds


def full_cyk(kinds):
    """Every span from all ways to cut it in two."""
    n = len(kinds)
    table = {(i, 1): repair.row_cell(kinds[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell = {}
            for cut in range(1, length):
                for key, found in repair.combined(table[i, cut], table[i + cut, length - cut]).items():
                    cell[key] = min(found, cell.get(key, found))
            table[i, length] = cell
    return table[0, n]


@pytest.mark.parametrize("seed", range(30))
def test_one_cut_gives_what_all_cuts_give(seed):
    rng = random.Random(seed)
    kinds = "".join(rng.choices(KINDS, weights=[2, 1, 5, 5, 1, 1, 2, 2, 1], k=rng.randint(1, 24)))
    assert repair.span_cell(kinds) == full_cyk(kinds)
    at = rng.randint(0, len(kinds))
    assert repair.combined(repair.span_cell(kinds[:at]), repair.span_cell(kinds[at:])) == repair.span_cell(kinds)


def plain(rows):
    """The contract for (conv_id, turn, role, text) in plain Python, forward over the pattern's states."""
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = {}
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        kinds, seen, counts = [], set(), [0, 0, 0]
        for turn, role, text in own:
            trimmed = text.strip(" \t\n\v\f\r")
            fault = 0 if not trimmed else 1 if (role, text) in seen else 2 if trimmed[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            kinds.append("d" if fault < 2 else letter.upper() if fault == 2 else letter)
        states = {0: (0, "", ())}

        def offer(into, q, value):
            if q not in into or value[:2] < into[q][:2]:
                into[q] = value

        def close(into):
            for _ in range(3):
                for p, (c, a, o) in list(into.items()):
                    for letter, role in (("u", "user"), ("a", "assistant")):
                        if (p, letter) in repair.STEPS:
                            offer(into, repair.STEPS[p, letter], (c + 5, a + "I", (*o, f"{role}:")))

        close(states)
        for kind, (_, role, text) in zip(kinds, own):
            after = {}
            for p, (c, a, o) in states.items():
                offer(after, p, (c + 2, a + "D", o))
                more = 5 if kind.isupper() else 0
                for letter, name in () if kind == "d" else (("s", None), ("u", "user"), ("a", "assistant")):
                    if (p, letter) in repair.STEPS:
                        q = repair.STEPS[p, letter]
                        if letter == kind.lower():
                            offer(after, q, (c + more, a + "K", (*o, f"{role}:{text}")))
                        if name:
                            offer(after, q, (c + 1 + more, a + "R", (*o, f"{name}:{text}")))
            close(after)
            states = after
        cost, audit, texts = min(states[q] for q in (0, 3) if q in states)
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made_rows():
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t", "Ok!\n ", "Why?\x0b", "a.b", "ü。", None, "long " * 5000]
    rows = []
    for conv in [*range(120), None, -7]:
        for turn in [*range(rng.randint(1, 9)), *[None] * rng.randint(0, 2)]:
            if rng.random() < 0.9:
                rows += [(conv, turn if rng.random() < 0.9 else 3, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.")] * (2 if rng.random() < 0.05 else 1)
    rows += [(1000, t, "user" if t % 2 else "assistant", f"t {t}." if t % 7 else "again.") for t in range(3000)]  # more than one range
    dropped = next(i for i in range(2000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "Gone.")]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", [1, 7])
def test_against_plain(spark, partitions):
    rows = made_rows()
    frame = spark.createDataFrame(rows, SCHEMA)
    for c in ("copies", "kind", "audit", "Digest", "a.b"):
        frame = frame.withColumn(c, F.lit("own"))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = repair.repair_conversations(repair.damage(frame), digests=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in FIELDS) == want[r.conv_id], r.conv_id
    assert want[max(c for c in want if c is not None)] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    frame = spark.createDataFrame([r for r in made_rows() if r[0] != 1000], SCHEMA)
    got = repair.repair_conversations(repair.damage(frame), digests=True).toPandas()
    db = connect("/root/testdata/sf0.001")
    table = frame.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    db.register("table_", table)
    db.execute("CREATE OR REPLACE VIEW conversations AS SELECT * FROM table_")
    same(got, db.sql(repair.ORACLE_SQL).df())


def test_repaired_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "A.", 1), (1, 1, "user", "B.", 1), (1, 2, "user", "B.", 1), (2, 0, "user", "x.", 0)], f"{SCHEMA}, copies int")
    got = sorted((r.conv_id, r["at"], r.edit, r.role, r.text) for r in repair.repair_conversations(frame).collect())
    assert got == [(1, 0, "R", "user", "A."), (1, 1, "R", "assistant", "B.")]
    assert {r.conv_id: (r.audit, r.duplicate) for r in repair.repair_conversations(frame, digests=True).collect()} == {1: ("RRD", 1), 2: ("", 0)}
    for digests in (False, True):
        assert repair.repair_conversations(frame.limit(0), digests).count() == 0


def test_op12_by_plain(spark):
    got = registry.QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r.conv_id: tuple(r[c] for c in FIELDS) for r in got} == plain(rows)
