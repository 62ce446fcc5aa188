"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows (10 consecutive words, or all its words if fewer), a window
into its word shingles. Shingles are ordered by how rarely they occur in the corpus. A text that
holds a window holds all of its shingles, so the join needs one prefix token of each window: its
rarest shingle. A match fixes where the window would start; bounds on position and length drop
what can't fit, and the words are compared one by one.

The corpus is read twice. A narrow pass counts the benchmark's shingles in it, and hands on counts
only; the join then meets each window's rarest shingle alone and checks the words in the scan, so
nothing but occurrences leaves it. What is broadcast comes in blocks whose size is counted beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import free_name, load, release, sha256_hex, words_column, written

#: A broadcast holds so many shingles or windows at most; more are taken in blocks.
BLOCK = 500_000
#: Digests of contaminated texts are broadcast up to this number, and joined by a shuffle beyond.
MOST_DIGESTS = 500_000


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words) of each distinct window; items without words have none."""
    words = items.select(F.col(id_col).alias("item"), words_column(F.col(text_col)).alias("all_words")).filter(F.size("all_words") > 0)
    starts = words.select("item", "all_words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("all_words") - window, F.lit(0)))).alias("at"))
    return starts.select("item", F.slice("all_words", F.col("at") + 1, F.lit(window)).alias("words")).distinct()


def _hash(words: str, start, size: int):
    return F.xxhash64(F.lit(size), *[F.get(words, start + j) for j in range(size)])


def contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5, block: int = BLOCK
) -> DataFrame:
    """One row for each row of docs: its columns but for the text, and what of the benchmark it holds.

    n_words; n_hit: words inside any occurrence of a window; items: sorted ids, as strings, of the
    items with occurring windows; n_items; contaminated: n_hit > 0. An occurrence is exact, word
    for word. A null text has no words. Items that repeat under one id count once; an item whose
    id is null hits words but isn't listed. An empty benchmark or corpus gives no hits or no rows.
    Repeated rows are judged alike. Columns of docs that clash with the made ones, in any case of
    letters, are replaced by these.
    """
    keep = [c for c in docs.columns if c != text_col]
    # Windows that several items share are one window; shingles of it start at each offset.
    owners = written(benchmark_windows(items, id_col, item_text_col, window), "windows")
    windows = written(owners.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "window-ids")
    offsets = windows.select("window", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - shingle, F.lit(0)))).alias("offset"))
    offsets = offsets.withColumn("k", F.least(F.size("words"), F.lit(shingle)))
    by_size = F.lit(None).cast("long")
    for k in range(1, shingle + 1):
        by_size = F.when(F.col("k") == k, _hash("words", F.col("offset"), k)).otherwise(by_size)
    offsets = written(offsets.withColumn("hash", by_size), "shingles")
    tokens = written(offsets.select("k", "hash").distinct(), "tokens")
    sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most `shingle` values

    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), F.concat(F.array(F.lit("")), words_column(F.col(f"`{text_col}`"))).alias("words"))
    # The empty word before each text keeps it in the result.
    n_words = F.size("words") - 1
    key = lambda k: F.struct(F.lit(k).alias("k"), F.when((F.col("pos") > 0) & (F.col("pos") + k - 1 <= n_words), _hash("words", F.col("pos"), k)).alias("hash"))

    def places(texts: DataFrame, own: bool) -> DataFrame:
        """texts by word, with the key of the shingle that starts there; with own, also a key of the text itself."""
        by_word = F.posexplode_outer("words").alias("pos", "word")
        rows = texts.select(*[c for c in texts.columns if own or c == "words"], by_word)
        keys = [F.struct(F.lit(0).alias("k"), F.when(F.col("pos") == 0, F.lit(0)).cast("long").alias("hash"))] * own + [key(k) for k in sizes]
        if len(keys) == 2 and own:
            return rows.withColumn("key", F.when(F.col("pos") == 0, keys[0]).otherwise(keys[1]))
        if not keys:
            return rows.limit(0).withColumn("key", F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("hash")))
        return rows.withColumn("key", keys[0]) if len(keys) == 1 else rows.withColumn("key", F.explode_outer(F.array(*keys)))

    def in_blocks(table: DataFrame, number: str) -> list[DataFrame]:
        n = max(1, -(-table.count() // block))
        return [table if n == 1 else table.filter(F.pmod(F.col(number), F.lit(n)) == i) for i in range(n)]

    meets = (F.col("key.hash") == F.col("met_hash")) & (F.col("key.k") == F.col("met_k"))
    often = None
    for part in in_blocks(tokens, "hash"):
        one = places(texts, False).join(F.broadcast(part.withColumnsRenamed({"k": "met_k", "hash": "met_hash"})), meets)
        one = one.groupBy(F.col("met_k").alias("k"), F.col("met_hash").alias("hash")).agg(F.count("*").alias("often"))
        often = one if often is None else often.union(one)
    often = written(often, "often")

    # Windows without an occurrence of their rarest shingle occur nowhere.
    rarest = Window.partitionBy("window").orderBy(F.coalesce("often", F.lit(0)), "hash", "offset")
    prefix = offsets.join(often, ["k", "hash"], "left").withColumn("rank", F.row_number().over(rarest)).filter("rank = 1 AND often > 0")
    prefix = written(prefix.select(F.col("k").alias("met_k"), F.col("hash").alias("met_hash"), "window", "offset", F.col("words").alias("wanted")), "prefix")
    parts = in_blocks(prefix, "window")
    if len(parts) > 1:  # rows keep their numbers over several readings
        texts = written(texts, "texts")
    start = F.col("pos") - 1 - F.col("offset")
    met = None
    for i, part in enumerate(parts):
        if i == 0:
            whole = docs.sparkSession.sql("SELECT 0 AS met_k, 0L AS met_hash")
            part = whole.select("met_k", "met_hash", *[F.lit(None).cast(t).alias(c) for c, t in prefix.dtypes[2:]]).union(part)
        one = places(texts, i == 0).join(F.broadcast(part), meets) if i == 0 else places(texts, True).filter("pos > 0").join(F.broadcast(part), meets)
        fits = (start >= 0) & (start + F.size("wanted") <= n_words) & (F.slice("words", start + 2, F.size("wanted")) == F.col("wanted"))
        one = one.filter((F.col("pos") == 0) | fits)
        one = one.select("row", F.when(F.col("pos") == 0, F.col("kept")).alias("kept"), n_words.alias("n_words"), "window", start.alias("start"), (start + F.size("wanted")).alias("end"))
        met = one if met is None else met.unionByName(one)
    met = written(met, "met")
    places_ = met.filter("window IS NOT NULL").select("row", "window", "start", "end")

    ids = windows.join(owners, "words").select("window", F.col("item").cast("string").alias("item"))
    listed = places_.select("row", "window").distinct().join(ids, "window").select("row", "item").distinct()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kind = met.schema["kept"].dataType
    parts = met.filter("window IS NULL").select("row", "kept", "n_words", none("span", "struct<start:int,end:int>"), none("item", "string"))
    parts = parts.union(places_.select("row", F.lit(None).cast(kind), none("n_words", "int"), F.struct("start", "end"), none("item", "string")).distinct())
    parts = parts.union(listed.select("row", F.lit(None).cast(kind), none("n_words", "int"), none("span", "struct<start:int,end:int>"), "item"))
    per_text = parts.groupBy("row").agg(F.max("n_words").cast("long").alias("n_words"), F.first("kept", ignorenulls=True).alias("kept"), F.array_sort(F.collect_list("span")).alias("spans"), F.array_sort(F.collect_list("item")).alias("items"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"].cast("long"))
    result = per_text.select("kept", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("spans") > 0).alias("contaminated"))
    made = [c for c in result.columns if c != "kept"]
    release(offsets, tokens, often, prefix)
    return result.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c.lower() not in made], *made)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text holds no window of an item, with all their columns.

    Whether a text is contaminated follows from the text, so digests of contaminated texts are joined back,
    by broadcast if they are few; no text is written or shuffled. A null or empty text stays, repeated rows
    stay or go together, an empty benchmark drops none, and columns of any name are kept.
    """
    digest = F.md5(F.col(f"`{text_col}`").cast("binary"))
    name = free_name(docs.columns, "digest")
    hit = contamination(docs.select(digest.alias(name), F.col(f"`{text_col}`").alias("text")), items, "text", **options)
    hit = written(hit.filter("contaminated").select(name).distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= MOST_DIGESTS else hit
    return docs.withColumn(name, digest).join(hit, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256_hex(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


_WORDS = "list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[o + 1 : o + 10] AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS o FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, n, pos, w[pos + 1 : pos + n] AS g FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS pos FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, n, pos, item_id FROM p JOIN win USING (g)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS x FROM (SELECT DISTINCT r, n, pos FROM m)) GROUP BY r),
l AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
"""
