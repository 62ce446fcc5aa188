"""N-gram Jaccard join by chosen paths.

A text is the set of its shingles of five words; texts with equal sets are one set with so many
copies. Sets are split recursively: at a node, a pseudo-random choice that all sets share samples
tokens, and a set follows each sampled token that it holds to a node below; a token is used once on
a path. A node with few sets is compared by brute force. At a node with many, all meet a few
representatives: sets like one are candidates with it, sets nearly equal to one go no further, since
whatever is linked with them is like that one too, and the others are split again. So a group
of thousands of near copies passes a node as thousands of rows. Tokens are sampled from the 64 least
hashes of a set. Of nodes with the same sets one is looked at.

Runs with choices of their own are repeated until the target recall: pairs that are alone in their
group, neither far from the least similarity nor close to 1, tell by how many of the runs found them
how many pairs all runs have missed; while these are too many, more runs are made.

What the paths find are candidates by sketch; the candidates' connected groups are disjoint, and each
is compared exactly. In a large group the sets are told by what they differ in from a pivot of the
group; two sets whose distances to the pivot add up to less than the allowed distance are linked, and
such links are counted by sums over distances, without a pair. The rest meets in pairs of blocks, a
task each, that hand on counts and a tree of the linked sets, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import connected_components, live_folders, load, release, release_since, words_of, written

SHINGLE, SKETCH = 5, 64
#: Runs made together, tokens sampled at a node of each depth (the last number holds below), least recall.
RUNS, SAMPLED, TARGET = 6, (2.0, 1.0), 0.999
#: Nodes of more sets are split; a group of more sets has a pivot and is compared in blocks of so many.
LEAF, REPRESENTATIVES, DEPTH, BLOCK = 32, 16, 8, 256
#: Sketches that share more are candidates in a small node, candidates with a representative, and as good as equal to it.
#: Sets of similarity 0.8 share 0.8 with a deviation of 0.05; one linked with an equal one shares 0.55 with the representative.
CLOSE, LIKE, EQUAL = 0.55, 0.42, 0.75
#: Row numbers are broadcast up to this many long integers, and joined by a shuffle beyond.
MOST_BROADCAST = 4_000_000
_KNOWN: dict[str, int] = {}


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than a shingle are one shingle."""
    import xxhash

    words = words_of(text)
    if len(_KNOWN) > 50_000:
        _KNOWN.clear()
    known, numbers = _KNOWN, []
    for w in words:
        n = known.get(w)
        if n is None:
            n = known[w] = xxhash.xxh64_intdigest(w)
        numbers.append(n)
    if not numbers:
        return np.empty(0, dtype=np.uint64)
    of = np.array(numbers, dtype=np.uint64)
    size = min(size, len(of))
    out = np.full(len(of) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        out = (out ^ of[j : len(of) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def sketches(text: pd.Series) -> pd.DataFrame:
    import xxhash

    rows = []
    for x in text:
        hashes = shingle_hashes(x)
        rows.append((xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else None, len(hashes), (hashes[:SKETCH] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
    return pd.DataFrame(rows, columns=["set", "n", "sketch"])


def _hashes_of(text: pd.Series) -> pd.Series:
    return pd.Series([shingle_hashes(x).view(np.int64) for x in text], dtype=object)


def by_group(work: Callable[[pd.DataFrame], list[tuple]], keys: list[str], columns: list[str], most: int = 20_000) -> Callable:
    """For mapInPandas over partitions sorted by keys: work is called with the rows of each group, whole.

    Thousands of small groups share a call of Python; a group that spans batches is put together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out = None, []
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            changes = np.zeros(len(batch), dtype=bool)
            for k in keys:
                column = batch[k].to_numpy()
                changes[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(changes).tolist()]
            for a, b in zip(starts, starts[1:]):
                out += work(batch.iloc[a:b])
            rest = batch.iloc[starts[-1] :]
            if len(out) > most:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if rest is not None and len(rest):
            out += work(rest)
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Least member of each one's linked group."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def compare_sketches(bucket: pd.DataFrame) -> list[tuple]:
    """(a, b, run, similarity by sketch) edges of a tree over the sets of one node whose sketches share enough."""
    ids, held, run = bucket["node"].tolist(), [set(s) for s in bucket["sketch"]], int(bucket["run"].iloc[0])
    order = sorted(range(len(ids)), key=ids.__getitem__)
    close = {}
    for i, x in enumerate(order):
        for j in range(i):
            y = order[j]
            shared = len(held[x] & held[y])
            union = len(held[x]) + len(held[y]) - shared
            if shared >= CLOSE * union:
                close[j, i] = shared / union
    roots = _roots(len(order), iter(close))
    return [(ids[order[i]], ids[order[r]], run, close.get((r, i), 1.0)) for i, r in enumerate(roots) if r != i]


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of a shares with each of b; only tokens on both sides are looked at, some at a time."""
    one, two = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(one, two)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    rows_a, rows_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    at_a, at_b = np.searchsorted(both, one), np.searchsorted(both, two)
    if not len(both):
        return out
    in_a, in_b = both[np.minimum(at_a, len(both) - 1)] == one, both[np.minimum(at_b, len(both) - 1)] == two
    rows_a, at_a, rows_b, at_b = rows_a[in_a], at_a[in_a], rows_b[in_b], at_b[in_b]
    for low in range(0, len(both), 8192):
        width = min(8192, len(both) - low)
        x, y = np.zeros((len(a), width), dtype=np.float32), np.zeros((len(b), width), dtype=np.float32)
        pick = (at_a >= low) & (at_a < low + width)
        x[rows_a[pick], at_a[pick] - low] = 1
        pick = (at_b >= low) & (at_b < low + width)
        y[rows_b[pick], at_b[pick] - low] = 1
        out += x @ y.T
    return out


def compare_exactly(similarity: tuple[int, int]) -> Callable[[pd.DataFrame], list[tuple]]:
    """(node, linked texts, root) for the sets of a pair of blocks; similarity as a fraction.

    diff is what a set and the group's pivot don't share (the whole set in a group without one), n the
    set's size. Pairs that the distances to the pivot decide are left out; they are counted elsewhere.
    """
    over, under = similarity

    def work(pair: pd.DataFrame) -> list[tuple]:
        pair = pair.sort_values("node", kind="stable")
        ids, copies, block = pair["node"].tolist(), pair["copies"].to_numpy(dtype=np.int64), pair["block"].to_numpy()
        first, second = int(pair["i"].iloc[0]), int(pair["j"].iloc[0])
        diffs = [np.asarray(s) for s in pair["diff"]]
        a = np.flatnonzero(block == first)
        b = a if first == second else np.flatnonzero(block == second)
        if not len(a) or not len(b):
            return []
        n, d = pair["n"].to_numpy(dtype=np.int64), np.array([len(s) for s in diffs])
        reach = (over + under) * d - (under - over) * n
        apart = d[a][:, None] + d[b][None, :] - 2 * shared_counts([diffs[i] for i in a], [diffs[i] for i in b])
        linked = (under - over) * (n[a][:, None] + n[b][None, :]) >= (over + under) * apart
        linked &= reach[a][:, None] + reach[b][None, :] > 0
        if first == second:
            np.fill_diagonal(linked, False)
        texts = np.zeros(len(ids), dtype=np.int64)
        texts[a] += linked @ copies[b]
        if first != second:
            texts[b] += linked.T @ copies[a]
        x, y = np.nonzero(linked)
        roots = _roots(len(ids), zip(a[x].tolist(), b[y].tolist()))
        return [(ids[i], int(texts[i]), ids[roots[i]]) for i in range(len(ids)) if texts[i]]

    return work


def _similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def candidate_edges(sets: DataFrame, runs: list[int]) -> DataFrame:
    """(a, b, run, similarity): trees over sets that met on a chosen path of these runs and whose sketches are close."""
    scale = 1 << 20

    def follow(nodes: DataFrame, sampled: float, first: bool) -> DataFrame:
        """The places below; those of the first depth are most of all, and leave out the sketch."""
        # The choice depends on path and token; a set's share of its tokens is the same whatever its size.
        fresh = F.array_except("sketch", "used")
        chosen = F.filter(fresh, lambda t: F.pmod(F.xxhash64(F.col("path"), t), F.lit(scale)) * F.size("sketch") < F.lit(int(scale * sampled)))
        kept = [] if first else ["sketch"]
        below = nodes.select("node", "run", "path", "used", *kept, F.explode(chosen).alias("token"))
        return below.select("node", "run", F.xxhash64("path", "token").alias("path"), F.concat("used", F.array("token")).alias("used"), *kept)

    start = F.explode(F.array(*[F.lit(r) for r in runs])).alias("run")
    places = sets.select("node", "sketch", start).select("node", "sketch", "run", F.col("run").cast("long").alias("path"), F.array().cast("array<int>").alias("used"))
    leaves, edges, scratch = [], [], []
    for depth in range(DEPTH):
        places = written(follow(places, SAMPLED[min(depth, len(SAMPLED) - 1)], depth == 0), f"path-{depth}")
        members = F.bit_xor(F.xxhash64("node", F.lit(1))), F.bit_xor(F.xxhash64("node", F.lit(2)))
        counts = places.groupBy("path").agg(F.count("*").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(members)], F.min("node").alias("least")).filter("n > 1")
        # Nodes with the same sets are one, but in runs of their own: these tell how well a run finds.
        if depth:
            once = counts.groupBy("n", "m0", "m1", "least").agg(F.min("path").alias("path")).select("path", "n")
        else:
            once = counts.select("path", "n")
        once = written(once, f"once-{depth}")
        # Most places are of nodes with one set. What has more is broadcast if it is short enough, so the places aren't dealt out again.
        leaves.append(written(places.join(_small(once.filter(F.col("n") <= LEAF).select("path")), "path").select("node", "run", "path"), f"leaves-{depth}"))
        large = once.filter(F.col("n") > LEAF)
        if large.isEmpty():
            release(places, once)
            break
        # A large node has REPRESENTATIVES of them, whose sketches its members get in parts, so no path is a hot key.
        parts = F.floor(F.col("n") / 2048).cast("int") + 1
        large = large.select("path", parts.alias("parts"))
        inside = places.join(_small(large), "path")
        inside = written(inside if depth else inside.join(sets.select("node", "sketch"), "node"), f"inside-{depth}")
        heads = inside.groupBy("path", "parts", F.pmod(F.xxhash64("node"), F.lit(REPRESENTATIVES)).alias("k")).agg(F.min_by(F.struct(F.col("node").alias("head"), F.col("sketch").alias("of_head")), "node").alias("h"))
        heads = heads.select("path", "parts", "h.*")
        heads = heads.groupBy("path", "parts").agg(F.array_sort(F.collect_list(F.struct("head", "of_head"))).alias("heads"))
        heads = written(heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), f"heads-{depth}")
        met = inside.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")
        met = met.join(heads.select("path", "part", "heads"), ["path", "part"])
        met = met.withColumn("near", F.transform("heads", lambda h: _similarity(F.col("sketch"), h["of_head"])))
        like = F.filter(F.transform("heads", lambda h, i: F.when(F.get("near", i) >= LIKE, h["head"])), lambda h: h.isNotNull())
        met = written(met.select("node", "sketch", "run", "path", "used", like.alias("like"), F.array_max("near").alias("nearest")), f"met-{depth}")
        # A set's own edge goes to one representative like it, and what else is like it is linked once for all sets alike.
        own = met.filter((F.size("like") > 0) & (F.col("node") != F.get("like", F.lit(0)))).select(F.col("node").alias("a"), F.get("like", F.lit(0)).alias("b"))
        shared = met.filter(F.size("like") > 1).select("like").distinct().select(F.explode(F.slice("like", 2, REPRESENTATIVES)).alias("a"), F.get("like", F.lit(0)).alias("b"))
        edges.append(written(own.union(shared).distinct().select("a", "b", F.lit(-1).alias("run"), F.lit(1.0).alias("similarity")), f"edges-{depth}"))
        release(places, once, heads, inside)
        scratch.append(met)
        places = met.filter(F.col("nearest") < EQUAL).select("node", "sketch", "run", "path", "used")
    else:  # Sets that share all tokens of so long a path are candidates together; the exact comparison decides.
        least = written(places.groupBy("path").agg(F.min("node").alias("b")), "least")
        rest = places.join(least, "path").filter("node <> b").select(F.col("node").alias("a"), "b", F.lit(-1).alias("run"), F.lit(1.0).alias("similarity"))
        edges.append(written(rest.distinct(), "edges-rest"))
        release(least)
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.union(more)
    buckets = leaf.join(sets.select("node", "sketch"), "node").repartition("path").sortWithinPartitions("path")
    close = written(buckets.mapInPandas(by_group(compare_sketches, ["path"], ["a", "b", "run", "similarity"]), "a long, b long, run int, similarity double"), "close")
    found = close
    for more in edges:
        found = found.union(more)
    release(*leaves, *scratch)
    return found


def estimated_recall(found: DataFrame, groups: DataFrame, n_runs: int) -> float:
    """Recall of n_runs runs, by the pairs that are alone in their group and neither too easy nor too hard.

    By how many runs a found pair was found follows a binomial distribution without its zero; the
    recall of one run is what gives the mean that is seen. No such pairs: 1.
    """
    alone = groups.groupBy("component").agg(F.count("*").alias("n")).filter("n = 2").select(F.col("component").alias("b"))
    pairs = found.filter("run >= 0 AND similarity < 0.95 AND similarity >= 0.7").join(alone, "b").groupBy("a", "b").agg(F.count_distinct("run").alias("times"))
    mean = pairs.agg(F.avg("times")).first()[0]
    if mean is None or mean >= n_runs:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        seen = n_runs * p / (1 - (1 - p) ** n_runs) if p > 1e-12 else 1.0
        low, high = (p, high) if seen < mean else (low, p)
    return 1 - (1 - low) ** n_runs


def candidate_groups(sets: DataFrame, target: float = TARGET) -> DataFrame:
    """(node, component) of sets that may be linked; runs are added until their estimated recall reaches target."""
    found, n_runs, batches = None, 0, []
    while True:
        before = live_folders()
        more = written(candidate_edges(sets, list(range(n_runs, n_runs + RUNS))), "candidates")
        release_since(sets.sparkSession, before, (more,))
        batches.append(more)
        found = more if found is None else found.union(more)
        n_runs += RUNS
        groups = connected_components(found.select("a", "b"), "groups")
        if estimated_recall(found, groups, n_runs) >= target:
            release(*batches)
            return groups
        release(groups)


def _small(frame: DataFrame) -> DataFrame:
    """frame, to be broadcast if it has few rows of a few numbers; it is counted for that."""
    return F.broadcast(frame) if frame.count() <= MOST_BROADCAST else frame


def exact_links(sets: DataFrame, texts: DataFrame, groups: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(node, texts) counts of linked texts, to be summed up, and (a, b) edges that connect what is linked.

    sets: node, copies. texts: row, text. groups: node, component.
    """
    over, under = similarity
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.select("node", "component").join(sizes, "component").join(sets.select("node", "copies"), "node")
    members = written(members.withColumnRenamed("component", "group"), "members")
    hashes_of = F.pandas_udf(_hashes_of, "array<long>")
    wanted = _small(members.select(F.col("node").alias("row")))
    shingles = written(texts.join(wanted, "row").select(F.col("row").alias("node"), hashes_of("text").alias("diff")), "shingles")
    small = members.filter(F.col("size") <= BLOCK).join(shingles, "node").withColumn("n", F.size("diff")).select("node", "group", "copies", "n", "diff", F.lit(0).alias("block"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    # Large groups: a pivot each; its shingles come in parts, so no group is a hot key.
    large = members.filter(F.col("size") > BLOCK)
    part = F.floor(F.col("size") / 1024).cast("int")
    pivots = large.groupBy("group", "size").agg(F.max_by("node", F.struct(F.col("copies"), -F.col("node"))).alias("node"))
    pivots = pivots.join(shingles, "node").select("group", F.col("diff").alias("of_pivot"), F.explode(F.sequence(F.lit(0), part)).alias("part"))
    placed = large.withColumn("part", F.pmod(F.xxhash64("node"), part + 1).cast("int")).join(shingles, "node").join(pivots, ["group", "part"])
    placed = placed.select("node", "group", "copies", F.size("diff").alias("n"), F.concat(F.array_except("diff", "of_pivot"), F.array_except("of_pivot", "diff")).alias("diff"))
    placed = written(placed.withColumn("reach", (over + under) * F.size("diff") - (under - over) * F.col("n")), "diffs")
    # Two sets with reach a + b <= 0 are linked. Sums by reach count them; each is connected through the least reach.
    spread = written(placed.groupBy("group", "reach").agg(F.sum("copies").alias("texts"), F.min("node").alias("node")), "spread")
    asked = spread.select("group", (-F.col("reach")).alias("reach"), F.lit(0).alias("texts"), F.lit(1).alias("ask")).union(spread.select("group", "reach", "texts", F.lit(0)))
    upto = asked.groupBy("group", "reach").agg(F.sum("texts").alias("texts"), F.max("ask").alias("ask"))
    upto = upto.select("group", F.col("reach"), "ask", F.expr("sum(texts) OVER (PARTITION BY group ORDER BY reach)").alias("texts")).filter("ask = 1").select("group", (-F.col("reach")).alias("reach"), "texts")
    nearest = spread.groupBy("group").agg(F.min(F.struct("reach", "node")).alias("nearest"))
    # One row for each group and reach, a few thousand for a group; copied 16 times so that equal reaches are no hot key.
    sums = written(upto.join(nearest, "group").select("group", "reach", "texts", "nearest").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))), "sums")
    counted = placed.select("node", "group", "copies", "reach", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int").alias("part")).join(sums, ["group", "part", "reach"])
    counted = written(counted.select("node", (F.col("texts") - F.when(F.col("reach") <= 0, F.col("copies")).otherwise(0)).alias("texts"), F.col("nearest.node").alias("root")).filter("texts > 0"), "counted")

    # The others: sets of positive reach meet all sets of their group, block by block.
    outer = F.col("reach") > 0
    by_side = placed.groupBy("group").agg(F.count_if(outer).alias("n_outer"), F.count_if(~outer).alias("n_inner"))
    by_side = by_side.select("group", F.ceil(F.col("n_outer") / BLOCK).cast("int").alias("outer"), F.ceil(F.col("n_inner") / BLOCK).cast("int").alias("inner"))
    open_ = placed.join(F.broadcast(by_side) if by_side.count() <= MOST_BROADCAST else by_side, "group").filter(F.col("outer") > 0)
    number = F.pmod(F.xxhash64("node"), F.when(outer, F.col("outer")).otherwise(F.col("inner"))).cast("int")
    open_ = open_.withColumn("block", number + F.when(outer, 0).otherwise(F.col("outer")))
    others = F.sequence(F.lit(0), F.when(outer, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    ends = F.explode(F.transform(others, lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))).alias("p")
    blocks = open_.select("node", "group", "copies", "n", "diff", "block", ends).select("node", "group", "copies", "n", "diff", "block", "p.i", "p.j")

    pairs = small.union(blocks).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    found = pairs.mapInPandas(by_group(compare_exactly(similarity), ["group", "i", "j"], ["node", "texts", "root"]), "node long, texts long, root long")
    found = written(found.union(counted), "links")
    release(members, shingles, placed, spread, sums, counted)
    return found.select("node", "texts"), found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def linked_sets(rows: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(set, n_links, head, copies) of the sets that some other text is linked with; head is the least (none, id, row) of the class."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    sets = rows.filter("n > 0").groupBy("set").agg(F.count("*").alias("copies"), F.min(order).alias("least"), F.first("sketch").alias("sketch"))
    # The number of the row that stands for a set names the set from here on.
    sets = written(sets.withColumn("node", F.col("least.row")), "sets")
    groups = candidate_groups(sets)
    before = live_folders()
    links, edges = exact_links(sets, rows.select("row", "text"), groups, similarity)
    links = written(links.groupBy("node").agg(F.sum("texts").alias("texts")), "sums")
    classes = connected_components(edges, "classes")
    joined = sets.select("set", "node", "copies", "least").join(classes.select("node", F.col("component").alias("class")), "node", "left").join(links, "node", "left").withColumn("class", F.coalesce("class", "node"))
    joined = written(joined.filter("copies > 1 OR texts > 0").select("set", "class", "least", "copies", (F.col("copies") - 1 + F.coalesce("texts", F.lit(0))).alias("n_links")), "linked")
    heads = joined.groupBy("class").agg(F.min("least").alias("head"), F.count("*").alias("sets"))
    # A class of one set is its own head; only the others meet, in parts.
    parts = F.floor(F.col("sets") / 1024).cast("int")
    heads = heads.filter("sets > 1").withColumn("part", F.explode(F.sequence(F.lit(0), parts))).select("class", "part", "head", parts.alias("parts"))
    sizes = heads.filter("part = 0 AND parts > 0").select("class", "parts")
    placed = joined.join(sizes, "class", "left").withColumn("part", F.pmod(F.xxhash64("set"), F.coalesce("parts", F.lit(0)) + 1).cast("int")).drop("parts")
    done = placed.join(heads.select("class", "part", "head"), ["class", "part"], "left").select("set", "n_links", F.coalesce("head", "least").alias("head"), "copies")
    done = written(done, "set-classes")
    release_since(rows.sparkSession, before, (done,))
    release(sets, groups)
    return done


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keep = [c for c in docs.columns if c != text_col]
    s = F.pandas_udf(sketches, "set string, n int, sketch array<int>")(F.col(f"`{text_col}`")).alias("s")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), s)
    return written(rows.select("row", "kept", "id", "text", "s.*"), "rows")


def _with_classes(rows: DataFrame, linked: DataFrame, columns: list[str]) -> DataFrame:
    """columns of rows with the head and n_links of the row's set, where there are any.

    Rows of a set with more copies than a 256th of all texts are dealt to several partitions; there are
    at most 256 such sets. Texts without words have no set and meet nothing.
    """
    fair = F.lit(max(1, rows.count() // 256))
    parts = F.floor(F.col("copies") / fair).cast("int")
    heavy = linked.filter(F.col("copies") > fair).select("set", parts.alias("parts"))
    named = rows.select(*columns, "set").filter("set IS NOT NULL").join(F.broadcast(heavy), "set", "left").withColumn("part", F.pmod(F.col("row"), F.coalesce("parts", F.lit(0)) + 1).cast("int"))
    copied = linked.select("set", "n_links", "head", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > fair, parts).otherwise(0))).alias("part"))
    return named.join(copied, ["set", "part"], "left").select(*columns, "head", "n_links")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """Each row of docs, but for the text, with class_id, n_links and first.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 4/5 or
    more; texts of fewer words have one shingle. n_links: other rows linked with the row, copies
    included. class_id: the least id in the row's connected group (nulls last); first: whether the
    row stands for its group, which is so for one row of each, whatever ties there are. A null text,
    and any without words, is linked with none and is a group of its own. Repeated rows are copies
    of each other. No rows give no rows. Columns that clash with the made ones, in any case of
    letters, are replaced.
    """
    rows = _numbered(docs, id_col, text_col)
    linked = linked_sets(rows, similarity)
    # The numbers without texts stay with the result; all else is deleted.
    lean = written(rows.select("row", "kept", "id", "set"), "lean")
    release(rows)
    alone = lean.filter("set IS NULL").select("row", "kept", "id", F.lit(None).cast(linked.schema["head"].dataType).alias("head"), F.lit(0).cast("long").alias("n_links"))
    whole = _with_classes(lean, linked, ["row", "kept", "id"]).union(alone)
    made = {
        "class_id": F.when(F.col("head").isNotNull(), F.col("head.id")).otherwise(F.col("id")), "n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
        "first": F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)),
    }
    keep = [c for c in docs.columns if c != text_col and c.lower() not in made]
    return whole.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep], *[v.alias(k) for k, v in made.items()])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """docs with one row of each group of linked texts, the first of jaccard_join(), with all columns.

    Only the numbers of the rows to drop meet the texts, by broadcast if they are few. Nulls, repeats and
    ties are as in jaccard_join(): every text without words stays.
    """
    rows = _numbered(docs, id_col, text_col)
    linked = linked_sets(rows, similarity)
    drop = written(_with_classes(rows, linked, ["row"]).filter("head.row <> row").select("row"), "near-copies")
    release(linked)
    kept = rows.join(_small(drop), "row", "left_anti")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


_WORDS = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, w[i + 1 : i + 5] AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * shared >= 4 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x),
c AS (SELECT x, min(c) AS class_id FROM r GROUP BY x), l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM d JOIN c ON c.x = doc_id LEFT JOIN l ON l.x = doc_id
"""
