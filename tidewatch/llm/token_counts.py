"""Token counts by trie-shared dynamic programming.

A unigram tokenizer cuts a pre-token (a word with the mark of a word's start) into the pieces of a
public vocabulary whose scores have the largest sum. The best score of a prefix depends on the
prefix alone, so the distinct pre-tokens are put into a trie and each node's forward score is
computed once, however many words run through it; the count at a word's last node is its number
of tokens. The trie is grown level by level over the new words of some texts at a time; tasks keep
bounded levels and bounded counts of words, and shuffle nothing.

The vocabulary's file gives an order of pieces but no probabilities; the score of the piece of
rank r among n is that of Zipf's law, ln(1 / (r * (1 + 1/2 + ... + 1/n))).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, load
from .vocabulary import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
START = "▁"
#: How much worse than the worst piece a letter without piece is; it counts as many tokens as it has bytes.
UNKNOWN = 10.0
MAX_NODES, MAX_WORDS, LONG, CHUNK = 200_000, 400_000, 64, 4_000_000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def zipf_scores(path: str) -> dict[str, float]:
    """Piece -> score, for the pieces that are text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


class Pieces:
    """The vocabulary as a trie in arrays: a step is looked up by place and letter in sorted keys."""

    def __init__(self, scores: dict[str, float]):
        known: dict[tuple[int, str], int] = {}
        own = [-math.inf]
        for piece, score in scores.items():
            at = 0
            for letter in piece:
                if (at, letter) not in known:
                    known[at, letter] = len(own)
                    own.append(-math.inf)
                at = known[at, letter]
            own[at] = score
        steps = sorted((at << 21 | ord(letter), to) for (at, letter), to in known.items())
        self.keys, self.to = np.array([k for k, _ in steps], dtype=np.int64), np.array([t for _, t in steps], dtype=np.int64)
        self.score = np.array(own)
        self.goes_on = np.zeros(len(own), dtype=bool)
        self.goes_on[self.keys >> 21] = True

    def step(self, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Where each place leads by a letter; -1 for nowhere."""
        if not len(self.keys):
            return np.full(len(at), -1, dtype=np.int64)
        key = at << 21 | letter
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.to[found], -1)


class ForwardTrie:
    """Distinct words as a trie that is grown level by level, all nodes of a level at once.

    A node has its forward score, the tokens of its best cut, and its open pieces: pieces that began
    at an ancestor or begin here and may go on below, with score and tokens at their start. Only the
    last level is kept; words of more than LONG letters, which few share, go through `cut`.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS):
        self.scores, self.longest, self.pieces = scores, max(map(len, scores), default=1), Pieces(scores)
        self.worst = min(scores.values(), default=0.0) - UNKNOWN
        self.max_nodes, self.max_words = max_nodes, max_words
        self.counts: dict[str, int] = {}

    def cut(self, word: str) -> int:
        """Tokens of one word, letter by letter; of cuts with equal scores, that with fewer tokens counts."""
        forward, tokens, get = [0.0], [0], self.scores.get
        for i, letter in enumerate(word, 1):
            best, n = -math.inf, 0
            for start in range(max(0, i - self.longest), i):
                score, more = get(word[start:i]), 1
                if score is None:
                    if start < i - 1:
                        continue
                    score, more = self.worst, _bytes_of(letter)
                total = forward[start] + score
                if total > best or total == best and tokens[start] + more < n:
                    best, n = total, tokens[start] + more
            forward.append(best)
            tokens.append(n)
        return tokens[-1]

    def insert(self, word: str) -> int:
        """Tokens of one word."""
        return self.insert_all([word])[word]

    def insert_all(self, words: list[str]) -> dict[str, int]:
        """Tokens of each of the distinct words; at most max_nodes words, so nodes of a level, are grown together."""
        out = {w: self.cut(w) for w in words if len(w) > LONG}
        words = sorted(w for w in words if len(w) <= LONG)
        for low in range(0, len(words), self.max_nodes):
            some = words[low : low + self.max_nodes]
            out.update(zip(some, self._grow(some)))
        return out

    def _grow(self, words: list[str]) -> list[int]:
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum(length)
        result = np.zeros(len(words), dtype=np.int64)
        alive = np.flatnonzero(length > 0)  # in order, so words with the same prefix stand together
        node, forward, tokens = np.zeros(len(alive), dtype=np.int64), np.zeros(1), np.zeros(1, dtype=np.int64)
        owner, at, from_score, from_tokens = (np.zeros(1, dtype=kind) for kind in (np.int64, np.int64, np.float64, np.int64))
        depth = 0
        while len(alive):
            letter = letters[ends[alive] - length[alive] + depth]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            parent, by = node[new], letter[new]
            node = np.cumsum(new) - 1
            # Every child takes over its parent's open pieces.
            held = np.bincount(owner, minlength=len(forward))
            first, many = np.cumsum(held) - held, held[parent]
            starts = np.cumsum(many) - many
            pick = np.repeat(first[parent] - starts, many) + np.arange(many.sum())
            child = np.repeat(np.arange(len(parent)), many)
            at, from_score, from_tokens, begins = at[pick], from_score[pick], from_tokens[pick], at[pick] == 0
            to = self.pieces.step(at, by[child])
            own = np.where(to >= 0, self.pieces.score[to], -np.inf)
            bare = begins & np.isneginf(own)  # a letter that is no piece
            more = np.ones(len(own), dtype=np.int64)
            more[bare] = 1 + (by[child[bare]] > 0x7F) + (by[child[bare]] > 0x7FF) + (by[child[bare]] > 0xFFFF)
            total = from_score + np.where(bare, self.worst, own)
            forward = np.maximum.reduceat(total, starts)
            tokens = np.minimum.reduceat(np.where(total == forward[child], from_tokens + more, np.iinfo(np.int64).max), starts)
            on = (to >= 0) & self.pieces.goes_on[to]
            owner = np.concatenate([child[on], np.arange(len(parent))])
            order = np.argsort(owner, kind="stable")
            owner, at = owner[order], np.concatenate([to[on], np.zeros(len(parent), dtype=np.int64)])[order]
            from_score, from_tokens = np.concatenate([from_score[on], forward])[order], np.concatenate([from_tokens[on], tokens])[order]
            depth += 1
            done = length[alive] == depth
            result[alive[done]] = tokens[node[done]]
            alive, node = alive[~done], node[~done]
        return result.tolist()

    def texts(self, texts: Iterable[str | None]) -> list[tuple[int, int]]:
        """Words and tokens of each text. Texts of about CHUNK letters are looked at together."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(_WORDS.findall(text) if text else [])
            size += len(text or "")
            if size > CHUNK:
                out += self._counted(some)
                some, size = [], 0
        return out + self._counted(some)

    def _counted(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        found = set().union(*texts)
        new = found - self.counts.keys()
        if len(self.counts) + len(new) > self.max_words:
            self.counts, new = {}, found
        for word, n in self.insert_all([START + w for w in new]).items():
            self.counts[word[1:]] = n
        get = self.counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in texts]


def _bytes_of(letter: str) -> int:
    return 1 + (letter > "\x7f") + (letter > "\u07ff") + (letter > "\uffff")


@lru_cache(2)
def trie_of(path: str) -> ForwardTrie:
    return ForwardTrie(zipf_scores(path))


def token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Each row of docs, but for the text, with n_words and n_tokens (long).

    Words are runs of characters other than blanks and \\t to \\r. A null or empty text has none.
    Repeated rows are counted alike. Columns that clash with the made ones, in any case of letters, are replaced.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def count(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(trie_of(path).texts(text), columns=["n_words", "n_tokens"])

    made = free_name(docs.columns, "counts")
    both = docs.select("*", F.pandas_udf(count, "n_words long, n_tokens long")(F.col(f"`{text_col}`")).alias(made))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in ("n_words", "n_tokens")]
    return both.select(*keep, F.col(f"{made}.n_words").alias("n_words"), F.col(f"{made}.n_tokens").alias("n_tokens"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents").select("doc_id", "text"))
