"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, the same on every machine. A three-letter gram is
the product of its letters' vectors, rolled by their place (binding); a text is the sum of its
grams' vectors (bundling), and so is a language of its texts. A text takes the language whose
prototype has the largest cosine with it.

Training sums whole numbers in each task, then by language and dimension, so the sums don't depend
on the order; what reaches the driver is one vector for each learned language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, load

#: Letters are told apart up to this code point; those beyond share the numbers up to SYMBOLS.
DISTINCT, SYMBOLS = 0x250, 1024
MAX_GRAMS = 30_000
#: A text's vector is brought to this many units for each gram before it is added to its language.
UNITS = 1000


class GramVectors:
    """Vectors of grams, made when first seen; a bounded number are kept."""

    def __init__(self, dimensions: int, seed: int):
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters
        self.dimensions = dimensions
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((256, self.dimensions), dtype=np.float32)

    def bundle(self, text: str | None) -> tuple[np.ndarray, int] | None:
        """Sum of the grams' vectors and the number of grams; None without any letter."""
        codes = grams(text)
        if codes is None:
            return None
        found, counts = np.unique(codes, return_counts=True)
        if len(self.rows) + len(found) > max(MAX_GRAMS, len(found)):
            self._clear()
        rows = self.rows
        new = [c for c in found.tolist() if c not in rows]
        if new:
            while len(rows) + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            at, n = len(rows), np.array(new)
            self.table[at : at + len(new)] = self.first[n >> 20] * self.second[(n >> 10) & 1023] * self.third[n & 1023]
            rows.update(zip(new, range(at, at + len(new))))
        return counts.astype(np.float32) @ self.table[[rows[c] for c in found.tolist()]], len(codes)


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Number of each code point's letter; 0 for what is none."""
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = c if c < DISTINCT else DISTINCT + c % (SYMBOLS - DISTINCT)
    return out


def grams(text: str | None) -> np.ndarray | None:
    """Numbers of the three-letter grams of a text, other characters being one blank between words."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    symbols = np.concatenate([[0], _symbols()[points], [0]])
    if not symbols.any():
        return None
    symbols = symbols[np.concatenate([[True], (symbols[1:] != 0) | (symbols[:-1] != 0)])]
    return (symbols[:-2] << 20) | (symbols[1:-1] << 10) | symbols[2:]


@lru_cache(2)
def vectors_of(dimensions: int, seed: int) -> GramVectors:
    return GramVectors(dimensions, seed)


def learn_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = 1024, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from all rows with a language and a letter."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = vectors_of(dimensions, seed), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                found = vectors.bundle(text)
                if found is not None:
                    whole = np.rint(found[0] * UNITS / found[1]).astype(np.int64)
                    if lang in sums:
                        sums[lang] += whole
                    else:
                        sums[lang] = whole
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [s.tolist() for s in sums.values()]})

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInPandas(bundle, "lang string, sums array<long>").select("lang", F.posexplode("sums").alias("at", "x"))
    sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    learned = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs")).orderBy("lang").collect()  # a row for each language
    return [r.lang for r in learned], np.array([[x.x for x in r.xs] for r in learned], dtype=np.float64).reshape(len(learned), dimensions)


def identify_language(docs: DataFrame, languages: list[str], prototypes: np.ndarray, text_col: str = "text", dimensions: int = 1024, seed: int = 7) -> DataFrame:
    """Each row of docs, but for the text, with lang_pred and score, the cosine (0 to 1).

    A null text, one without letters, and every text if no language was learned is `und`, score 0.
    Of equal cosines the first language in order wins. Repeated rows are judged alike. Columns that
    clash with the made ones, in any case of letters, are replaced.
    """
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    unit = (prototypes / np.where(norms == 0, 1, norms)).T.astype(np.float32)

    def predict(text: pd.Series) -> pd.DataFrame:
        vectors, out = vectors_of(dimensions, seed), []
        for x in text:
            found = vectors.bundle(x) if languages else None
            if found is None:
                out.append(("und", 0.0))
                continue
            cosines = found[0] @ unit / max(float(np.linalg.norm(found[0])), 1e-9)
            best = int(np.argmax(cosines))
            out.append((languages[best], round(min(max(float(cosines[best]), 0.0), 1.0), 6)))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    made = free_name(docs.columns, "found")
    both = docs.select("*", F.pandas_udf(predict, "lang_pred string, score double")(F.col(f"`{text_col}`")).alias(made))
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in ("lang_pred", "score")]
    return both.select(*keep, F.col(f"{made}.lang_pred").alias("lang_pred"), F.col(f"{made}.score").alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1)
    languages, prototypes = learn_prototypes(docs.filter(~F.col("held_out")))
    return identify_language(docs.select("doc_id", "text", "held_out"), languages, prototypes)
