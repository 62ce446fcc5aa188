"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a prefix is the encoding of a shorter prefix and one last token: the only token
that ends there and may stand after the shorter prefix's last token. So a trie of the distinct
words needs one state for each node, the last token of the prefix, found once however many words
share it; a word's ids are read backwards along these states. Two tokens may stand side by side if
no merge across their border comes before the merges that built them.

Each task keeps a trie and a table of finished words; both are bounded and begin anew when full,
which changes no result. Texts are processed where they are read: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import load
from .vocabulary import byte_letters, read_word_bpe, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Nodes of a trie before a task begins a new one, and words in each of its two generations of finished words.
MAX_NODES, MAX_WORDS = 400_000, 250_000
# Letters, digits and signs of texts that are ASCII or Latin; of these the patterns below hold whatever the Unicode version.
_LATIN = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ʯ"
_ODD = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]")
_PLAIN_WORDS = re.compile(f"[{_LATIN}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\t-\\r {_LATIN}0-9]+")


class WordTrie:
    """Word -> ids under one vocabulary, with shared prefixes encoded once."""

    def __init__(self, path: str, max_nodes: int = MAX_NODES, max_words: int = MAX_WORDS):
        spec = read_word_bpe(path)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.texts = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.longest = max(map(len, self.ids))
        # Tokens as they may end at a node: without the word end, or at a word's last letter.
        self.inner = {t for t in self.ids if not t.endswith(END)}
        self.last = {t for t in self.ids if t.endswith(END)}
        self.letters = byte_letters()
        self.max_nodes, self.max_words = max_nodes, max_words
        self.fits: dict[tuple[str, str], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        # A special token stands in the list of words as (None, its text).
        self.special_words = {(None, t): (1, str(i)) for t, i in self.special_ids.items()}
        self.text_of = {str(i): t for i, t in self.texts.items()}
        self.words, self.older = dict(self.special_words), {}
        self._clear()

    def _clear(self) -> None:
        """Node 0 is the root; a node has the letter's children, its last token, and the node before that token."""
        self.children: dict[tuple[int, str], int] = {}
        self.token: list[str] = [""]
        self.before: list[int] = [-1]

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """Pieces at the token's left (0) or right (1) end, and the rank of the merge that takes each up."""
        found = self.spines[side].get(token)
        if found is None:
            piece, found = token, [(token, float("inf"))]
            while piece in self.parts:
                rank = self.rank[self.parts[piece]]
                piece = self.parts[piece][side]
                found.append((piece, rank))
            self.spines[side][token] = found
        return found

    def may_follow(self, left: str, right: str) -> bool:
        """Whether left and right stay apart: no merge over their border comes in time.

        Of equal ranks the leftmost merge comes first.
        """
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            known, rank_of, rights = True, self.rank.get, self._spine(right, 0)
            for a, a_taken in self._spine(left, 1):
                for b, b_taken in rights:
                    rank = rank_of((a, b))
                    if rank is not None and rank < a_taken and rank <= b_taken:
                        known = False
            self.fits[left, right] = known
        return known

    def _state(self, path: list[int], letters: str, known: set[str], end: str) -> tuple[str, int]:
        """Last token of letters + end and the node before it; path: the nodes of the prefixes."""
        n = len(letters)
        for start in range(max(0, n - self.longest), n):
            token = letters[start:] + end
            if token in known and (start == 0 or self.may_follow(self.token[path[start]], token)):
                return token, path[start]
        raise ValueError(f"no token ends {letters!r}")

    def encode(self, word: str) -> list[str]:
        """Tokens of one word, given as letters of bytes."""
        if len(self.token) > self.max_nodes:
            self._clear()
        path, node = [0], 0
        for i in range(1, len(word)):
            child = self.children.get((node, word[i - 1]))
            if child is None:
                token, before = self._state(path, word[:i], self.inner, "")
                child = len(self.token)
                self.children[node, word[i - 1]] = child
                self.token.append(token)
                self.before.append(before)
            node = child
            path.append(node)
        token, node = self._state(path, word, self.last, END)
        tokens = [token]
        while node > 0:
            tokens.append(self.token[node])
            node = self.before[node]
        return tokens[::-1]

    def word(self, word: str) -> tuple[int, str]:
        """How many tokens a word has, and its ids joined by spaces."""
        found = self.words.get(word) or self.older.get(word)
        if found is None:
            letters = word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode("utf-8")])
            tokens = self.encode(letters)
            found = (len(tokens), " ".join([str(self.ids[t]) for t in tokens]))
        if len(self.words) > self.max_words:
            self.words, self.older = dict(self.special_words), self.words
        self.words[word] = found
        return found

    def split(self, text: str) -> list[str | None]:
        """Words of a text in order; a special token is (None, its text)."""
        pieces = re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text) if "<|" in text else [text]
        out: list = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append((None, piece))
            elif piece:
                out += _words(piece)
        return out

    def text(self, text: str | None) -> tuple[int, str]:
        """n tokens and ids of a whole text; a null text is empty."""
        words = self.split(text) if text else []
        if not words:
            return 0, ""
        get, word = self.words.get, self.word
        n, ids = zip(*[get(w) or word(w) for w in words])
        return sum(n), " ".join(ids)

    def decode(self, ids: str) -> str:
        """The text that ids, joined by spaces, stand for: their tokens joined by spaces. Ids that no token has stand for nothing."""
        if not ids:
            return ""
        try:
            return " ".join(map(self.text_of.__getitem__, ids.split(" ")))
        except KeyError:
            return " ".join([self.text_of[i] for i in ids.split(" ") if i in self.text_of])


@lru_cache(1)
def _unicode_patterns():
    import regex

    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"), regex.compile(r"\p{White_Space}+")


def _words(piece: str) -> list[str]:
    """Normal form C, lower case letter by letter, then words, single digits and runs of signs."""
    if not _ODD.search(piece):
        return _PLAIN_WORDS.findall(piece.lower())
    words, space = _unicode_patterns()
    piece = space.sub(" ", unicodedata.normalize("NFC", piece))
    return words.findall("".join([c.lower() for c in piece]))


@lru_cache(2)
def trie_of(path: str) -> WordTrie:
    return WordTrie(path)


ENCODED = "n_tokens long, ids string, decoded string"


def bpe_encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, digests: bool = False, copy_text: bool = False) -> DataFrame:
    """Each row of docs with n_tokens, ids (array<int>) and decoded, the text that the ids stand for.

    With digests, ids_sha256 and decoded_sha256 (of the ids joined by spaces, and of the decoded
    text) stand in their place, so that large results needn't leave the task. A null text is
    encoded like an empty one: no tokens. Repeated rows are encoded alike. Columns that clash with
    the made ones, in any case of letters, are replaced.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def encode(text: pd.Series) -> pd.DataFrame:
        trie = trie_of(path)
        sha = (lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()) if digests else (lambda s: s)
        # What is decoded are the ids that were made, and nothing else of the text.
        rows = [(n, sha(ids), sha(trie.decode(ids))) for n, ids in map(trie.text, text)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded"])

    keep = [c for c in docs.columns if c != text_col or copy_text]
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.pandas_udf(encode, ENCODED)(F.col(f"`{text_col}`")).alias("e")).select("kept", "e.*")
    if digests:
        both = both.select("kept", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
    else:
        both = both.select("kept", "n_tokens", F.filter(F.split("ids", " "), lambda x: x != "").cast("array<int>").alias("ids"), "decoded")
    made = [c for c in both.columns if c != "kept"]
    return both.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c.lower() not in made], *made)


def bpe_decode(encoded: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """encoded with decoded: the tokens of the ids joined by spaces; null ids give null, unknown and null ones nothing.

    Repeated rows are decoded alike; a column called decoded, in any case of letters, is replaced.
    """
    path = vocabulary or vocabulary_path(VOCABULARY)

    def decode(ids: pd.Series) -> pd.Series:
        trie = trie_of(path)
        return pd.Series([None if x is None else trie.decode(x) for x in ids])

    joined = F.array_join(F.col(f"`{ids_col}`").cast("array<string>"), " ")
    keep = [F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"]
    return encoded.select(*keep, F.pandas_udf(decode, "string")(joined).alias("decoded"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(load(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
