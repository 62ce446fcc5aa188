"""Best-fit packing of documents into token sequences by exact-complement hashing.

Documents become pieces of at most `capacity` tokens where they are read. How pieces can share
sequences depends on their lengths alone, so one count for each length (at most `capacity` numbers)
is all that the plan needs: for each length, longest first, indexes of single, pair and triple sums
of the lengths still there give combinations that fill its gap exactly, and a combination is taken
as often as its scarcest length allows. What has no exact complement goes, longest first, where it
leaves the least room. Every step takes up a whole length or a whole class of equal sequences, so
the plan is as small for billions of pieces as for thousands.

A piece's place follows from its number among the pieces of its length: tasks number their own,
and the numbers before a task come from its counts. Only narrow rows are shuffled, by length and
task, so that a length which many pieces have is spread out.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .bpe_codec import VOCABULARY
from .common import load, written
from .vocabulary import vocabulary_path

CAPACITY, END_ID = 2048, 0
#: White-space separated chunks whose ids a task keeps before it begins anew, and letters of the texts it looks at together.
MAX_CHUNKS, LOOK = 800_000, 4_000_000
#: Letters of texts that can be cut at white space and lower-cased as they are; others go whole through the tokenizer.
_UNUSUAL = re.compile(r"[^\t-\r\x20-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]|<\|")
_SIGNS = ".,;:!?"


class TokenIds:
    """Texts -> their ids as little-endian 32-bit numbers. The tokenizer meets each distinct chunk once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        """A word and the signs after it are tokens apart, so a chunk that ends in signs is put together of both."""
        if len(self.known) + len(chunks) > MAX_CHUNKS:
            self.known = {}
        new = list(chunks - self.known.keys())
        words = [c.rstrip(_SIGNS) for c in new]
        parts = {p for c, w in zip(new, words) if w.isalpha() for p in (w, c[len(w) :]) if p} | {c for c, w in zip(new, words) if not w.isalpha()}
        missing = list(parts - self.known.keys())
        self.known.update(zip(missing, self._encode(missing)))
        known = self.known
        for c, w in zip(new, words):
            if c not in known:
                known[c] = known[w] + known[c[len(w) :]]

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size > LOOK:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        usual = [None if _UNUSUAL.search(t) else t.lower().split() for t in texts]
        self._learn(set().union(*[c for c in usual if c]))
        get = self.known.__getitem__
        return (self._encode([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, usual))


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


class SumIndex:
    """Lengths that are still there, with their counts, and which sums two of them can have."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.pairs = np.zeros(2 * capacity + 1, dtype=np.int64)  # how many pairs of lengths have a sum
        for length, n in counts.items():
            self.counts[length] = n
        for length in np.flatnonzero(self.counts):
            self.pairs[length + np.flatnonzero(self.counts[:length])] += 1
            self.pairs[2 * length] += self.counts[length] >= 2

    def take(self, combination: Counter, times: int) -> None:
        for length, n in combination.items():
            before = self.counts[length]
            after = self.counts[length] = before - n * times
            self.pairs[2 * length] -= (before >= 2) and (after < 2)
            if after == 0:
                others = np.flatnonzero(self.counts)
                self.pairs[length + others[others != length]] -= 1

    def enough(self, combination: Counter) -> bool:
        return all(self.counts[x] >= n for x, n in combination.items())

    def pair(self, total: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths of that sum beside the taken ones, the larger as large as can be."""
        if total < 2 or not self.pairs[total]:
            return None
        larger = np.arange(min(total - 1, len(self.counts) - 1), (total - 1) // 2, -1)
        for b in larger[(self.counts[larger] > 0) & (self.counts[total - larger] > 0)].tolist():
            if self.enough(Counter((*taken, b, total - b))):
                return b, total - b
        return None

    def filling(self, length: int, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap beside `length` exactly, the fewest and largest first."""
        if self.counts[gap] and self.enough(Counter((length, gap))):
            return (gap,)
        found = self.pair(gap, (length,))
        if found is None and gap >= 3:
            largest = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
            for b in largest[(self.counts[largest] > 0) & (self.pairs[gap - largest] > 0)].tolist():
                if (rest := self.pair(gap - b, (length, b))) is not None:
                    return b, *rest
        return found


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths in each) that take up all pieces; counts: length -> pieces.

    Exact complements first, then best fit, longest first. No counts give no sequences.
    """
    index = SumIndex(counts, capacity)
    plan: list[tuple[int, tuple[int, ...]]] = []
    for length in range(capacity, 0, -1):
        while (here := int(index.counts[length])) > 0:
            filling = () if length == capacity else index.filling(length, capacity - length)
            if filling is None:
                break
            lengths = (length, *filling)
            need = Counter(lengths)
            times = min(int(index.counts[x]) // n for x, n in need.items()) if filling else here
            index.take(need, times)
            plan.append((times, lengths))
    # Sequences with room, by how much; each class is one entry however many sequences it stands for.
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(times: int, lengths: tuple[int, ...], room: int) -> None:
        if times and room:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((times, lengths))
        elif times:
            plan.append((times, lengths))

    for length in range(capacity, 0, -1):
        left = int(index.counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                times, lengths, room = left, (), capacity
            else:
                room = rooms[at]
                times, lengths = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            fit = room // length  # best fit puts equal lengths on each other while there is room
            whole = min(times, left // fit)
            some = left % fit if whole < times else 0
            put(whole, lengths + (length,) * fit, room - fit * length)
            put(int(some > 0), lengths + (length,) * some, room - some * length)
            if lengths:
                put(times - whole - (some > 0), lengths, room)
            left -= whole * fit + some
    return plan + [c for room in rooms for c in open_[room]]


class Places:
    """From (length, number among the pieces of that length) to (sequence, offset)."""

    def __init__(self, plan: list[tuple[int, tuple[int, ...]]]):
        slots, used, sequence = [], Counter(), 0
        for times, lengths in plan:
            offset = 0
            for length in lengths:
                slots.append((length, used[length], sequence, offset))
                used[length] += times
                offset += length
            sequence += times
        self.length, self.first, self.sequence, self.offset = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4).T
        self.key = (self.length << 48) + self.first

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + number, side="right") - 1
        return self.sequence[at] + number - self.first[at], self.offset[at]


PIECES = "key string, piece int, start long, length long, ids_crc32 long, ids binary, task int, number long"


def document_pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: id_col, piece, start, length, ids_crc32, ids (null unless wanted), task, number.

    A document is its text's ids and END_ID; a null text is empty. number counts the task's pieces of one length.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)
    size, end = 4 * capacity, END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, numbers = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            made: list[tuple] = []
            for key, ids in zip(batch["key"].tolist(), token_ids(path).texts(batch["text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size] if len(ids) > size else ids
                    n = len(part) // 4
                    made.append((key, piece, at // 4, n, zlib.crc32(part), part if with_ids else None, task, numbers[n]))
                    numbers[n] += 1
            yield pd.DataFrame(made, columns=[c.split(" ")[0] for c in PIECES.split(", ")])

    # Ids may be null, which pandas would turn to floats: they travel as text.
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{text_col}`").alias("text"))
    pieces = rows.mapInPandas(cut, PIECES)
    return pieces.select(F.col("key").cast(docs.schema[id_col].dataType).alias(id_col), *pieces.columns[1:])


def pack_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id_col, piece, start, length, ids_crc32, sequence_id, offset, and ids (32-bit numbers) if wanted.

    A null or empty text is one piece of one token. Repeated rows and equal or null ids are documents
    of their own, packed apart. No rows give no pieces. Other columns of docs are left out, so no name can clash.
    """
    pieces = written(document_pieces(docs, text_col, id_col, capacity, vocabulary, with_ids), "pieces")
    of_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = written(of_task, "piece-counts")
    # At most `capacity` rows reach the driver: how many pieces have each length.
    places = Places(plan_sequences({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))

    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = pieces.join(before, ["length", "task"]).withColumn("at", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("number") + F.col("earlier")))
    return numbered.select(id_col, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids array<long>, starts) of pieces packed with ids; starts: where each piece begins.

    A sequence holds at most `capacity` tokens, so no group is large.
    """
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), pieces.alias("pieces"))
    return grouped.select("sequence_id", "n_tokens", _numbers(F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), "")).alias("ids"), F.transform("pieces", lambda p: p["offset"]).alias("starts"))


def _numbers(digits: Column) -> Column:
    """Little-endian 32-bit numbers of a string of hex digits."""
    number = lambda i: F.conv(F.concat(*[F.substring(digits, i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), (F.length(digits) / 8 - 1).cast("int")), number)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))
