"""Conversation structure repair by weighted CYK parsing of spans of rows.

A conversation should be empty, or a system row at most and then user and assistant rows in turn. The
pattern has four states; a nonterminal (p, q) of the repair grammar stands for rows that lead from
state p to state q. In Chomsky normal form its rules are (p, q) -> (p, r) (r, q) for two spans side
by side, and (p, q) -> one edit of one row. A span's cell holds for each nonterminal the least
(cost, audit), the audit being the edits' initials; cells of single rows are closed under insertions
on both sides. Of two audits of one cost for one span none is the beginning of the other (what is
longer has insertions that cost more), so the least of two spans side by side is made of the least
of each.

The grammar has a nonterminal for every pair of states, so that all ways to cut a span in two give
the same cell: spans are combined bottom-up by length, each from its two halves. A span that lies in
several tasks is parsed in each and combined by cell, so a conversation with many rows is split like
any other. Rows travel without texts for this; texts then meet their conversation's audit once and
run through one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import load, written

#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (EMPTY, ASSISTANT)
STEPS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Rows up to which a span's cell is remembered by its kinds.
SHORT = 16

Cell = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    cell: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            if (other := right.get((r, q))) is not None:
                found = (cost + other[0], audit + other[1])
                if (p, q) not in cell or found < cell[p, q]:
                    cell[p, q] = found
    return cell


def _closure() -> Cell:
    """Nothing, or insertions of user and assistant rows as the pattern allows."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    one = {(p, q): (INSERT, "I") for (p, c), q in STEPS.items() if c != "s"}
    for _ in STATES:
        longer = combined(cell, one)
        cell = {k: min(x for x in (cell.get(k), longer.get(k)) if x) for k in cell.keys() | longer.keys()}
    return cell


INSERTIONS = _closure()


@lru_cache(64)
def row_cell(kind: str) -> Cell:
    """The cell of one row. kind: d must be deleted, else the role's initial (x: another), a capital if truncated."""
    cell: Cell = {(p, p): (DELETE, "D") for p in STATES}
    if kind != "d":
        more = TRUNCATED if kind.isupper() else 0
        for (p, c), q in STEPS.items():
            edits = [(more, "K")] * (c == kind.lower()) + [(REROLE + more, "R")] * (c != "s")
            if edits:
                cell[p, q] = min(edits)
    return combined(combined(INSERTIONS, cell), INSERTIONS)


@lru_cache(100_000)
def _short_cell(kinds: str) -> Cell:
    half = len(kinds) // 2
    return row_cell(kinds) if half == 0 else combined(_short_cell(kinds[:half]), _short_cell(kinds[half:]))


def all_combined(cells: list[Cell]) -> Cell:
    """The cell of spans in a row, bottom-up: neighbours first, then their spans."""
    while len(cells) > 1:
        cells = [combined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTIONS


def span_cell(kinds: str) -> Cell:
    """The cell of the rows of these kinds; of no rows, insertions alone."""
    return all_combined([_short_cell(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)])


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[EMPTY, q] for q in ENDS if (EMPTY, q) in cell)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of each row after damage by the CRC of "conv_id:turn"; nulls become one space.

    Of 20 remainders 0 drops the row (no copies), 1 empties its text, 2 takes away `.`, `!` and `?`, 3 makes
    two copies, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _turn_order() -> Column:
    """Nulls first, as a value that min() can take."""
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn")


def marked_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows without texts: conv_id, turn, role, digest (MD5 of the text), kind, blank, copies.

    kind is that of the first copy, as row_cell() takes it; "-" stands for rows without copies. Rows
    seen earlier have kind d. Repeated rows are counted before they are shuffled, and texts that a
    conversation repeats are found by their first turn, so no conversation comes into one task.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    blank, initial = trimmed == "", F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    kind = F.when(blank, "d").when(F.right(trimmed, F.lit(1)).isin(*".!?"), letter).otherwise(F.upper(letter))
    there = F.col("copies") > 0
    narrow = rows.select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, F.md5(F.col("text").cast("binary"))).alias("digest"), F.when(there, kind).otherwise("-").alias("kind"), F.coalesce(there & blank, F.lit(False)).alias("blank"), "copies")
    distinct = narrow.groupBy("conv_id", "turn", "role", "digest", "kind", "blank").agg(F.sum("copies").alias("copies"))
    repeated = distinct.filter("kind not in ('-', 'd')").groupBy("conv_id", "role", "digest").agg(F.min(_turn_order()).alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = F.coalesce(_turn_order() > F.col("first"), F.lit(False))
    return distinct.join(repeated, same, "left").select("conv_id", "turn", "role", "digest", F.when(seen, "d").otherwise(F.col("kind")).alias("kind"), "blank", "copies")


SEGMENT = "key string, segment int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, first_turn long, last_turn long, first_initial string, last_initial string, cell string"
FIELDS = [c.split(" ")[0] for c in SEGMENT.split(", ")]


class Segment:
    """Counts and kinds of one conversation's rows in one task."""

    def __init__(self, key: str | None, number: int):
        self.key, self.number = key, number
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.least = None
        self.first_initial = self.last_initial = None
        self.kinds: list[str] = []

    def add(self, turn: int | None, initial: str, kind: str, blank: bool, copies: int) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns += turn != self.last_turn
            self.least = turn if self.least is None else self.least
        if self.rows == 0:
            self.first_turn, self.first_initial = turn, initial
        else:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.last_turn, self.last_initial = turn, initial
        self.rows += copies
        self.illegal += copies - 1  # no role may follow itself
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - (kind != "d")
        self.truncated += kind.isupper()
        self.kinds.append(kind + "d" * (copies - 1))

    def row(self) -> tuple:
        cell = ",".join(f"{p}{q}{cost}:{audit}" for (p, q), (cost, audit) in span_cell("".join(self.kinds)).items())
        # Rows come by turn, nulls first: the first turn that isn't null is the least, the last one the greatest.
        return self.key, self.number, self.rows, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.least, self.last_turn, self.first_turn, self.last_turn, self.first_initial, self.last_initial, cell


def _cell_of(text: str) -> Cell:
    cell: Cell = {}
    for part in text.split(","):
        cost, _, audit = part[2:].partition(":")
        cell[int(part[0]), int(part[1])] = (int(cost), audit)
    return cell


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a range of (conversation, turn, ..), in order, to a row for each conversation."""
    number, now, made = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for key, turn, initial, kind, blank, copies in zip(*[batch[c].tolist() for c in ("key", "turn", "initial", "kind", "blank", "copies")]):
            if now is None or key != now.key:
                if now:
                    made.append(now.row())
                now = Segment(key, number)
            now.add(None if turn is None else int(turn), initial, kind, blank, copies)
        yield _frame(made, FIELDS)
        made = []
    yield _frame([now.row()] if now else [], FIELDS)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Whole numbers that may be null stay whole."""
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="object") for i, c in enumerate(columns)})


REPAIR = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments in order of conversation and number to a row for each conversation."""
    now: list[dict] = []

    def finished() -> tuple:
        there = [s for s in now if s["rows"]]
        known = [s for s in there if s["turns"]]
        gaps = 0
        if known:
            distinct = sum(s["turns"] for s in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
            gaps = known[-1]["most"] - known[0]["least"] + 1 - distinct
        illegal = sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(there, there[1:]))
        cost, audit = cheapest(all_combined([_cell_of(s["cell"]) for s in there]))
        return now[0]["key"], gaps, *[sum(s[c] for s in there) for c in ("blank", "duplicate", "truncated")], illegal + sum(s["illegal"] for s in there), cost, audit

    columns = [c.split(" ")[0] for c in REPAIR.split(", ")]
    for batch in batches:
        made = []
        for values in zip(*[batch[c].tolist() for c in FIELDS]):
            segment = dict(zip(FIELDS, values))
            for c in ("least", "most", "first_turn", "last_turn"):
                segment[c] = None if segment[c] is None else int(segment[c])
            if now and segment["key"] != now[0]["key"]:
                made.append(finished())
                now = []
            now.append(segment)
        yield _frame(made, columns)
    yield _frame([finished()] if now else [], columns)


def audits(rows: DataFrame) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the MD5 of the text, copies
    together. A conversation without rows has zeros and an empty audit.
    """
    order = ["conv_id", "turn", "role", "digest"]
    marked = written(marked_rows(rows), "marked-rows")  # ranges are found by reading it once more
    letter = F.substring("role", 1, 1).alias("initial")
    text = lambda *names: [F.col(c).cast("string").alias(c) for c in names]  # noqa: E731  whole numbers that may be null travel as text
    ranges = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = ranges.select(F.col("conv_id").cast("string").alias("key"), *text("turn"), letter, "kind", "blank", "copies").mapInPandas(_segments, SEGMENT)
    combined_ = segments.repartition("key").sortWithinPartitions("key", "segment").select("key", "segment", "rows", "blank", "duplicate", "truncated", "illegal", "turns", *text("least", "most", "first_turn", "last_turn"), "first_initial", "last_initial", "cell")
    found = combined_.mapInPandas(_repairs, REPAIR)
    return found.select(F.col("key").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *found.columns[1:])


def _edited(audit: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stands in the repaired conversation, in order."""
    state, at = EMPTY, 0

    def made(edit: str, role: str, text: str) -> tuple[str, str, str]:
        nonlocal state
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = STEPS[state, role[:1]]
        return edit, role, "" if edit == "I" else text

    for role, text, copies in rows:
        for _ in range(copies):
            while audit[at] == "I":
                yield made("I", "", "")
                at += 1
            if audit[at] != "D":
                yield made(audit[at], role, text)
            at += 1
    while at < len(audit):
        yield made("I", "", "")
        at += 1


def repair_conversations(rows: DataFrame, digests: bool = False) -> DataFrame:
    """The rows of all repaired conversations: conv_id, at (from 0), edit (K, R or I), role, text.

    With digests a row for each conv_id instead: gaps, blank, duplicate, truncated, illegal, cost,
    audit, and repaired_sha256 of `role:text`, joined by newlines. rows: conv_id, turn, role, text and
    copies (0: the row is not there, but its conversation is); null roles and texts aren't allowed, null
    ids are one conversation, no rows give no rows, and other columns are left out. The digest is a chain
    over a conversation's rows, so these run through one task, one at a time.
    """
    heads = audits(rows).select("conv_id", F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    bodies = rows.filter("copies > 0").select("conv_id", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies"))
    order = ["conv_id", F.col("head").isNull(), "turn", "role", F.md5(F.col("text").cast("binary"))]
    both = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions(*order)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    flat = both.select(F.col("conv_id").cast("string").alias("key"), *[F.coalesce(F.col(f"head.{c}"), F.lit(0)).alias(c) for c in counts], "head.audit", "role", "text", "copies")
    schema = f"key string, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string" if digests else "key string, at long, edit string, role string, text string"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch[c].tolist() for c in flat_columns])

    flat_columns = flat.columns

    def repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_, made, size = stream(batches), [], 0
        head = next(rows_, None)
        while head is not None:
            after = None

            def own() -> Iterator[tuple[str, str, int]]:
                nonlocal after
                for row in rows_:
                    if row[7] is not None:  # the next conversation's head
                        after = row
                        return
                    yield row[8], row[9], row[10]

            digest, n = hashlib.sha256(), 0
            for edit, role, text in _edited(head[7], own()):
                if digests:
                    digest.update((("\n" if n else "") + f"{role}:{text}").encode())
                else:
                    made.append((head[0], n, edit, role, text))
                    size += len(text)
                n += 1
                if len(made) >= 10_000 or size > 10_000_000:
                    yield _frame(made, columns)
                    made, size = [], 0
            if digests:
                made.append((head[0], *head[1:8], digest.hexdigest()))
            head = after
        yield _frame(made, columns)

    found = flat.mapInPandas(repaired, schema)
    return found.select(F.col("key").cast(rows.schema["conv_id"].dataType).alias("conv_id"), *found.columns[1:])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair_conversations(rows, digests=True)


#: CRC-32 of ASCII text, bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1),
  lambda i: list_transform(range(8), lambda b: ((ascii(key[i]) >> b) & 1)::BIGINT)))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))"""


def _value(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"


def _least(*values: str) -> str:
    return f"list_sort([{', '.join(values)}])[1]"


def _row_sql(state: str, before: str) -> str:
    """The least value of a state after a row of letter l, with t more if it stays; before: states that lead here."""
    letter = {"s": "s", "u": "u", "a": "a"}[state]
    stay = [f"CASE WHEN l = '{letter}' THEN {_value(p, 't', 'K')} END" for p in before.split()]
    change = [f"CASE WHEN l <> 'd' THEN {_value(p, '1 + t', 'R')} END" for p in before.split() if state != "s"]
    return f"list_sort(list_filter([{', '.join([_value(state, '2', 'D'), *stay, *change])}], lambda v: v IS NOT NULL))[1]"


_CLOSED_SQL = f"""SELECT k, n, e, s, {_least("u", _value("e", "5", "I"), _value("s", "5", "I"), _value("a", "5", "I"))} AS u,
  {_least("a", _value("u", "5", "I"), _value("e", "10", "II"), _value("s", "10", "II"))} AS a"""

ORACLE_SQL = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, {_CRC_SQL} % 20 AS h FROM keyed),
damaged AS (
  SELECT k, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text)) AS n, left(role, 1) AS i FROM damaged),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY n) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS short, lag(i) OVER (PARTITION BY k ORDER BY n) AS i0 FROM ordered),
letters AS (SELECT *, CASE WHEN blank OR again THEN 'd' WHEN i IN ('s', 'u', 'a') THEN i ELSE 'x' END AS l, CASE WHEN short THEN 5 ELSE 0 END AS t FROM marked),
counted AS (
  SELECT k, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate,
    sum((short AND NOT again AND NOT blank)::INT) AS truncated, sum((n > 1 AND i0 || i NOT IN ('su', 'ua', 'au'))::INT) AS illegal
  FROM letters GROUP BY k),
steps AS (
  {_CLOSED_SQL} FROM (SELECT DISTINCT k, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS e, {{'c': 1000000000::BIGINT, 'a': ''}} AS s,
    {{'c': 1000000000::BIGINT, 'a': ''}} AS u, {{'c': 1000000000::BIGINT, 'a': ''}} AS a FROM keyed)
  UNION ALL
  {_CLOSED_SQL} FROM (
    SELECT k, n, {_value("e", "2", "D")} AS e, {_row_sql("s", "e")} AS s, {_row_sql("u", "e s a")} AS u, {_row_sql("a", "u")} AS a
    FROM (SELECT steps.k, letters.n, e, s, u, a, l, t FROM steps JOIN letters ON letters.k = steps.k AND letters.n = steps.n + 1))),
ended AS (SELECT steps.k, list_sort([e, a])[1] AS best FROM steps LEFT JOIN counted USING (k) WHERE steps.n = coalesce(n_rows, 0)),
edits AS (SELECT k, j, best.a[j] AS edit FROM (SELECT k, best, unnest(range(1, length(best.a) + 1)) AS j FROM ended)),
placed AS (
  SELECT k, j, edit, sum((edit <> 'I')::INT) OVER (PARTITION BY k ORDER BY j) AS n, sum((edit <> 'D')::INT) OVER (PARTITION BY k ORDER BY j) AS o FROM edits),
outputs AS (
  SELECT p.k, p.j, p.edit, o, l.role, l.text, max((o = 1 AND edit = 'K' AND l.i = 's')::INT) OVER (PARTITION BY p.k) AS shift
  FROM placed p LEFT JOIN letters l ON l.k = p.k AND l.n = p.n AND p.edit <> 'I' WHERE edit <> 'D'),
texts AS (
  SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole
  FROM outputs GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM keyed) LEFT JOIN counted USING (k) JOIN ended USING (k) LEFT JOIN texts USING (k)
"""
