"""Vector code compression: product codebooks, with nearest entries found by a GNAT over them.

Vectors become whole numbers, so that codebooks, codes and errors are the same on every machine and
in any order of rows. Each part position has its own codebook; a round assigns every part to its
nearest entry and replaces entries by means, from sums and counts that tasks add up before the
shuffle. Codebooks have parts x entries rows whatever the table's size; they alone reach the driver.

A GNAT (geometric near-neighbour access tree) picks a few entries as split points, gives each other
entry to its nearest split point, and keeps for each pair of a split point and a child the range of
distances between them. Distances of a query to the split points then rule out whole children. The
ranges are rounded outwards and a child goes only if it must be strictly farther than the best entry
so far, so equal distances are always compared as whole numbers and the lower index wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import free_name, load, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a node, and entries up to which a node is a leaf.
DEGREE, LEAF = 6, 8
#: Components below this in size keep squared distances within 53 bits for parts of up to 256; larger ones are Python's whole numbers.
SMALL = 1 << 21
LARGEST = (1 << 63) - 1


def _distance(queries: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of queries to one entry, exact."""
    apart = queries - entry
    return (apart * apart).sum(axis=1)


def _root_below(squares: np.ndarray) -> np.ndarray:
    """A number not above the square root, as floats."""
    return np.maximum(np.sqrt(squares.astype(float)) * (1 - 1e-12) - 1e-9, 0.0)


def _root_above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float)) * (1 + 1e-12) + 1e-9


@dataclass
class Node:
    """Entries of a leaf, or split points with a child for each and, by split point and child, the least and greatest distance."""

    entries: list[int]
    children: list[Node | None] = field(default_factory=list)
    least: np.ndarray | None = None
    greatest: np.ndarray | None = None


class Gnat:
    """Nearest entries of one codebook. compared counts distances between a query and an entry."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.entries, self.degree, self.leaf, self.compared = entries, degree, leaf, 0
        self.root = self._build(list(range(len(entries))))

    def _build(self, members: list[int]) -> Node:
        if len(members) <= self.leaf:
            return Node(members)
        splits = [members[0]]
        nearest = _distance(self.entries[members], self.entries[splits[0]])
        while len(splits) < self.degree and nearest.max() > 0:  # far from each other, greedily
            splits.append(members[int(nearest.argmax())])
            nearest = np.minimum(nearest, _distance(self.entries[members], self.entries[splits[-1]]))
        if len(splits) == 1:  # all are equal: only the lowest index can win
            return Node([min(members)])
        rest = [m for m in members if m not in splits]
        table = np.array([_distance(self.entries[rest], self.entries[s]) for s in splits]).reshape(len(splits), len(rest))
        owner = table.argmin(axis=0) if rest else np.empty(0, dtype=int)
        least, greatest = np.full((len(splits), len(splits)), np.inf), np.full((len(splits), len(splits)), -np.inf)
        children: list[Node | None] = []
        for j in range(len(splits)):
            own = np.flatnonzero(owner == j)
            children.append(self._build([rest[i] for i in own]) if len(own) else None)
            if len(own):
                least[:, j], greatest[:, j] = _root_below(table[:, own].min(axis=1)), _root_above(table[:, own].max(axis=1))
        return Node(splits, children, least, greatest)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the index of its nearest entry, the lower one of equals, and the squared distance."""
        best = np.full(len(queries), len(self.entries), dtype=np.int64)
        error = np.full(len(queries), LARGEST, dtype=queries.dtype)
        if len(queries):
            self._search(self.root, queries, np.arange(len(queries)), best, error)
        return best, error

    def _search(self, node: Node, queries: np.ndarray, at: np.ndarray, best: np.ndarray, error: np.ndarray) -> None:
        squares = []
        for e in node.entries:
            d = _distance(queries[at], self.entries[e])
            self.compared += len(at)
            new = best[at] == len(self.entries)
            nearer = new | (d < error[at]) | ((d == error[at]) & (e < best[at]))
            best[at[nearer]], error[at[nearer]] = e, d[nearer]
            squares.append(d)
        if not node.children:
            return
        below, above = [_root_below(d) for d in squares], [_root_above(d) for d in squares]
        order = np.argsort([d.astype(float).mean() for d in squares])
        for j in order:  # children near most queries first: what they find rules out more of the others
            child = node.children[j]
            if child is None:
                continue
            reach = _root_above(error[at])
            left = np.ones(len(at), dtype=bool)
            for i in range(len(node.entries)):
                left &= (below[i] - reach <= node.greatest[i, j]) & (above[i] + reach >= node.least[i, j])
            if left.any():
                self._search(child, queries, at[left], best, error)


def _whole(vectors: pd.Series, dimension: int) -> np.ndarray:
    """floor(SCALE * x) of vectors of one dimension; Python's whole numbers where 64 bits could overflow."""
    scaled = np.floor(SCALE * np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), dimension))
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


@dataclass
class Codebooks:
    """entries: by part, entry and position; all parts have equally many entries, none if no vector was kept."""

    entries: list[list[list[int]]]
    dimension: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        arrays = [np.array(part, dtype=object).reshape(len(part), self.dimension // len(self.entries)) for part in self.entries]
        return [Gnat(a if a.size and max(abs(x) for x in a.ravel()) >= SMALL else a.astype(np.int64)) for a in arrays]


def kept_vectors(vectors: DataFrame, vec_col: str, dimension: int | None = None) -> DataFrame:
    """Rows whose vector isn't null and holds no null, NaN or infinite component; of one dimension if it is given."""
    x = F.col(f"`{vec_col}`")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False)) & (F.lit(True) if dimension is None else F.size(x) == dimension))


def usual_dimension(vectors: DataFrame, vec_col: str) -> int | None:
    """The dimension that most kept vectors have, the larger of equals; None without any."""
    sizes = kept_vectors(vectors, vec_col).groupBy(F.size(f"`{vec_col}`").alias("size")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.col("n").desc(), F.col("size").desc()).first()
    return found and found["size"]


def first_codebooks(vectors: DataFrame, vec_col: str, id_col: str, parts: int, entries: int) -> Codebooks:
    """The kept vectors of the smallest ids, cut into parts. Null ids come last; rows of one id are ordered by vector."""
    dimension = usual_dimension(vectors, vec_col) or 0
    if dimension % parts:
        raise ValueError(f"{parts} equal parts can't be cut from {dimension} components")
    kept = kept_vectors(vectors, vec_col, dimension).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    whole = [_whole(pd.Series([r.v]), dimension)[0].tolist() for r in kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    size = dimension // parts
    return Codebooks([[w[p * size : (p + 1) * size] for w in whole] for p in range(parts)], dimension)


def _assigned(batch: pd.Series, books: Codebooks, trees: list[Gnat]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its whole numbers, nearest entries and squared distances."""
    whole, size = _whole(batch, books.dimension), books.dimension // len(trees)
    for p, tree in enumerate(trees):
        own = whole[:, p * size : (p + 1) * size]
        # Of different kinds, Python's whole numbers win: numpy then computes with them.
        yield own, *(tree.nearest(own if own.dtype == tree.entries.dtype else own.astype(object)))


#: Sums travel in limbs of 10**18, since large components can exceed what a decimal holds.
LIMB = 10**18
SUMS = "part int, entry int, position int, high long, middle long, low long, n long"


def next_codebooks(kept: DataFrame, vec_col: str, books: Codebooks) -> Codebooks:
    """Entries replaced by floor(sum / count) of the parts that are nearest to them; entries without parts stay."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, totals, counts = books.trees(), {}, {}
        for batch in batches:
            for p, (own, entry, _) in enumerate(_assigned(batch["v"], books, trees)):
                for e in np.unique(entry).tolist():
                    mine = own[entry == e]
                    counts[p, e] = counts.get((p, e), 0) + len(mine)
                    for position, x in enumerate(mine.sum(axis=0).tolist()):
                        totals[p, e, position] = totals.get((p, e, position), 0) + int(x)
        rows = [(p, e, i, x // LIMB // LIMB, x // LIMB % LIMB, x % LIMB, counts[p, e]) for (p, e, i), x in totals.items()]
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SUMS.split(", ")])

    sums = kept.select(F.col(f"`{vec_col}`").alias("v")).mapInPandas(add, SUMS)
    limbs = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "middle", "low")]
    entries = [[list(e) for e in part] for part in books.entries]
    for r in sums.groupBy("part", "entry", "position").agg(*limbs, F.sum("n").alias("n")).collect():  # parts x entries x positions at most
        entries[r.part][r.entry][r.position] = ((int(r.high) * LIMB + int(r.middle)) * LIMB + int(r.low)) // r.n
    return Codebooks(entries, books.dimension)


def train_codebooks(vectors: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after some rounds over all kept vectors, begun with the vectors of the smallest ids.

    Rows of another dimension than most take no part. No kept rows give empty codebooks. Components are
    32-bit floats, or 64-bit ones below 1e40 in size.
    """
    books = first_codebooks(vectors, vec_col, id_col, parts, entries)
    for _ in range(rounds if books.dimension else 0):
        books = next_codebooks(kept_vectors(vectors, vec_col, books.dimension), vec_col, books)
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks, vec_col: str = "embedding") -> DataFrame:
    """Kept rows of vectors, but for the vector, with code (two hex digits a part) and error (long).

    Null vectors, vectors with null or non-finite components and those of another dimension than the
    codebooks' go; repeated rows are encoded alike. An error beyond a long is the largest long. Columns
    that clash with the made ones, in any case of letters, are replaced.
    """

    def encode(v: pd.Series) -> pd.DataFrame:
        codes, errors = [""] * len(v), [0] * len(v)
        for _, entry, square in _assigned(v, books, books.trees()):
            codes = [c + f"{e:02x}" for c, e in zip(codes, entry.tolist())]
            errors = [a + int(b) for a, b in zip(errors, square.tolist())]
        return pd.DataFrame({"code": codes, "error": [min(e, LARGEST) for e in errors]})

    kept = kept_vectors(vectors, vec_col, books.dimension)
    made = free_name(vectors.columns, "made")
    both = kept.select("*", F.pandas_udf(encode, "code string, error long")(F.col(f"`{vec_col}`")).alias(made))
    keep = [F.col(f"`{c}`") for c in vectors.columns if c != vec_col and c.lower() not in ("code", "error")]
    return both.select(*keep, F.col(f"{made}.code").alias("code"), F.col(f"{made}.error").alias("error"))


def decode_vectors(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """coded with decoded: the whole numbers that the code's entries stand for. A null code gives null."""
    parts = F.array(*[F.array(*[F.array(*[F.lit(x).cast("long") for x in e]) for e in part]) for part in books.entries])
    if not books.entries[0]:
        return coded.withColumn("decoded", F.lit(None).cast("array<bigint>"))
    indexes = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.conv(F.substring(F.col(f"`{code_col}`"), 2 * p + 1, F.lit(2)), 16, 10).cast("int"))
    whole = F.flatten(F.zip_with(parts, indexes, lambda part, i: part[i]))
    return coded.withColumn("decoded", F.when(F.col(f"`{code_col}`").isNotNull(), whole))


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error: error summed over rows of an equal label, null labels together.

    coded must be written, as it is read twice. Labels are summed before they are joined back; Spark
    splits a label with many rows, since the other side has one row for each label.
    """
    label = F.col(f"`{label_col}`")
    null, own = free_name(coded.columns, "null"), free_name(coded.columns, "own")
    keyed = coded.withColumns({null: label.isNull(), own: F.coalesce(label.cast("string"), F.lit(""))})
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = keyed.groupBy(null, own).agg(total.alias("label_error"))
    keep = [F.col(f"`{c}`") for c in coded.columns if c.lower() != "label_error"]
    return keyed.join(sums.withColumnRenamed("label_error", made := free_name(keyed.columns, "total")), [null, own]).select(*keep, F.col(made).alias("label_error"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train_codebooks(vectors)
    coded = written(encode_vectors(vectors, books), "vector-codes")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    """Assignments a{n} to the codebooks b{n}, and the codebooks that follow."""
    return f"""
a{n} AS (SELECT r, p, e, d FROM (SELECT r, p, e, sum((q - c) * (q - c)) AS d FROM x JOIN b{n} USING (p, i) GROUP BY r, p, e)
       QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1),
s{n} AS (SELECT p, e, i, sum(q)::BIGINT AS s, count(*) AS n FROM x JOIN a{n} USING (r, p) GROUP BY p, e, i),
b{n + 1} AS (SELECT p, e, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{n} LEFT JOIN s{n} USING (p, e, i)),"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, (k - 1) // (len(v) // {PARTS}) AS p, (k - 1) % (len(v) // {PARTS}) AS i, floor({SCALE} * v[k]::DOUBLE)::BIGINT AS q
      FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
b0 AS (SELECT p, r - 1 AS e, i, q AS c FROM x WHERE r <= {ENTRIES}),{"".join(map(_round_sql, range(ROUNDS + 1)))}
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
