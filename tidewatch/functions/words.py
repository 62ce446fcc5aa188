"""Normalising and counting words of whole texts, batch by batch in Python workers.

Equal to the expressions of text.py, which serve for short texts and inside other expressions; a text
is read once here, however many of its words, counts or hash bits are wanted.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import STOP_WORDS

_MARKS = re.compile("[̀-ͯ]+")
_ADDRESS = re.compile(rb"https?://[^ \t\n\x0b\f\r]+")
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789'-" else 32 for c in range(256))
#: Distinct words that a worker remembers; beyond, it begins anew.
REMEMBERED = 1 << 18


def words_of(text: str) -> list[bytes]:
    """Words of normalize_text(): letters that fold to no ASCII one separate words, but belong to addresses."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        for quote in "‘’“”":
            text = text.replace(quote, "'")
    plain = text.encode("ascii", "replace").lower()
    if b"://" in plain:
        plain = _ADDRESS.sub(b" ", plain)
    return plain.translate(_KEPT).split()


def normalized(text: Column) -> Column:
    """normalize_text() of whole texts."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else b" ".join(words_of(t)).decode() for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def _fnv(word: bytes) -> int:
    h = 14695981039346656037
    for c in word:
        h = (h ^ c) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def _fnvs(words: list[bytes]) -> list[int]:
    """_fnv() of each word, all words byte by byte at once; long ones alone."""
    order = sorted((i for i in range(len(words)) if len(words[i]) <= 32), key=lambda i: -len(words[i]))
    lengths = np.array([len(words[i]) for i in order], np.int64)
    flat = np.frombuffer(b"".join(words[i] for i in order), np.uint8).astype(np.uint64)
    starts, hashes = np.cumsum(lengths) - lengths, np.full(len(order), 14695981039346656037, np.uint64)
    for at in range(int(lengths[0]) if order else 0):
        n = int(np.searchsorted(-lengths, -at))  # so many words are longer
        hashes[:n] = (hashes[:n] ^ flat[starts[:n] + at]) * np.uint64(1099511628211)
    known = dict(zip(order, hashes.tolist()))
    return [known[i] if i in known else _fnv(w) for i, w in enumerate(words)]


def _tokens_of(text: str | None, known: dict[bytes, bytes], min_length: int, stops: frozenset[bytes]) -> dict[bytes, int]:
    """Tokens with their counts; known tells the token of each word met before, which is empty for words that are none."""
    found: dict[bytes, int] = {}
    for word, n in Counter(words_of(text or "")).items():
        token = known.get(word)
        if token is None:
            token = word.strip(b"-'")
            if len(token) < min_length or token in stops or len(token) == 1 and token.isdigit():
                token = b""
            known[word] = token
        if token:
            found[token] = found.get(token, 0) + n
    return found


_COUNTS = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))


def token_counts(text: Column, min_length: int = 3, stop_words: tuple[str, ...] = STOP_WORDS, votes: bool = False, counts: bool = True, most: int | None = None) -> Column:
    """Tokens of a text with their counts, most frequent first, ties by token; none for a null text. With most, only so many.

    With votes a struct (counts, n, votes): how many tokens, repeats too, and in the lower and upper half of each of 32
    longs how often bits b and b + 32 of their FNV-1a hashes are set. Without counts these are null.
    """
    stops = frozenset(w.encode() for w in stop_words)

    def run(texts: pa.Array) -> pa.Array:
        tokens, numbers, ends, halves, sums, known, hashes = [], [], [0], [], [], {}, {}
        for text in texts.to_pylist():
            if len(known) > REMEMBERED:
                known.clear()
                hashes.clear()
            found = _tokens_of(text, known, min_length, stops)
            if votes:
                new = [t for t in found if t not in hashes]
                hashes.update(zip(new, _fnvs(new)))
                own = [hashes[t] for t in found]
                sums.append(sum(found.values()))
                exact = np.float32 if sums[-1] < 1 << 24 else np.float64
                bits = np.unpackbits(np.array(own, "<u8").view(np.uint8).reshape(len(own), 8), axis=1, bitorder="little")
                ones = (np.fromiter(found.values(), exact, len(own)) @ bits.astype(exact)).astype(np.int64)
                halves.append(ones[:32] + (ones[32:] << 32))
            if counts:
                if most is not None and len(found) > most:
                    least = sorted(found.values(), reverse=True)[most - 1]
                    first = sorted((-n, t) for t, n in found.items() if n >= least)[:most]
                    found = {t: -n for n, t in first}
                ranked = sorted(found)
                ranked.sort(key=found.__getitem__, reverse=True)
                tokens += ranked
                numbers += map(found.__getitem__, ranked)
                ends.append(len(tokens))
        if counts:
            flat = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["token", "n"])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat).cast(_COUNTS)
            if not votes:
                return listed
        else:
            listed = pa.nulls(len(texts), _COUNTS)
        starts = pa.array(np.arange(len(halves) + 1, dtype=np.int32) * 32)
        made = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(halves) if halves else np.zeros(0, np.int64)))
        return pa.StructArray.from_arrays([listed, pa.array(sums, pa.int64()), made], ["counts", "n", "votes"])

    kind = "array<struct<token: string, n: bigint>>"
    return F.arrow_udf(run, f"struct<counts: {kind}, n: bigint, votes: array<bigint>>" if votes else kind)(text)


#: Values of the hash by which first words of aliases are told.
BUCKETS = 1 << 18


def bucket_of(word: Column) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(BUCKETS)).cast("int")


def runs_of(text: Column, starts: dict[int, frozenset[int]]) -> Column:
    """Distinct runs of n words whose first word has its bucket among those that starts gives for n."""

    def run(texts: pa.Array) -> pa.Array:
        known: dict[bytes, tuple[int, ...]] = {}
        out = []
        for text in texts.to_pylist():
            if len(known) > REMEMBERED:
                known.clear()
            words, found = words_of(text or ""), set()
            for i, word in enumerate(words):
                lengths = known.get(word)
                if lengths is None:
                    bucket = crc32(word) % BUCKETS
                    lengths = known[word] = tuple(n for n, buckets in starts.items() if bucket in buckets)
                for n in lengths:
                    if i + n <= len(words):
                        found.add(b" ".join(words[i : i + n]).decode())
            out.append(list(found))
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)
