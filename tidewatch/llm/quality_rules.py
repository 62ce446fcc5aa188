"""Quality rules whose thresholds come from the corpus.

Each text gets a few counts. For every language and source, each measure of them is summed up in a
histogram with bins of bounded relative width, a quantile sketch: the lower edge of a bin keeps the
six highest bits of a value, so a quantile is off by 1/32 at most, and sketches merge by adding
counts. Sketches of groups are merged to that of the language, and these to that of the corpus.
Fences beyond the tails replace fixed cutoffs: those of a group are weighed by its rows with those
above it, without a switch at some size, and joined to the texts by group.
Whatever the size of a source, its sketch has a few hundred bins, counted before the shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import load, release, written

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text; zeros for a null text."""
    words = _WORDS.findall(text) if text else []
    if not words:
        return (0, 0, sum(map((text or "").count, _SYMBOLS)), 0, 0, 0)
    lines, seen, n_lines = text.split("\n"), set(), 0
    for line in lines:
        if _WORDS.search(line):
            n_lines += 1
            seen.add(line)
    threes, repeated = list(zip(words, words[1:], words[2:])), 0
    if len(set(threes)) < len(threes):
        often, end = Counter(threes), 0
        for i, three in enumerate(threes):
            if often[three] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), n_lines, n_lines - len(seen), repeated)


def counts_of(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(x) for x in text], columns=[c.split()[0] for c in COUNTS.split(", ")])


#: Measures in whole numbers: name, expression, whether a low and a high fence hold, the tail in percent, and the reach in tenths.
#: A single symbol decides nothing.
MEASURES = {
    "word_length": ("100 * word_chars div greatest(n_words, 1)", True, True, 90, 50),
    "symbols": ("10000 * greatest(n_symbols - 1, 0) div greatest(word_chars, 1)", False, True, 90, 50),
    "dup_lines": ("10000 * n_dup_lines div greatest(n_lines, 1)", False, True, 99, 15),
    "repeats": ("10000 * n_repeat_words div greatest(n_words, 1)", False, True, 99, 15),
}


def fences(counted: DataFrame, group: tuple[str, str], prior: int) -> DataFrame:
    """(the group's columns, rows, <measure>_low, <measure>_high) for each group with texts that pass the fixed rules.

    A fence of a group, a first column or the corpus lies `reach` times the distance from the median to the
    tail beyond the median, bins counting whole, so that texts in the median's own bin are never outside. A group's fence is weighed with that of its first column, and this with the
    corpus's, by rows against `prior`: a group of few rows has nearly the fence above it, one of many its own.
    """
    first, second = group
    stack = ", ".join(f"'{name}', {m[0]}" for name, m in MEASURES.items())
    values = counted.filter("NOT base_failed").select(first, second, F.expr(f"stack({len(MEASURES)}, {stack}) AS (measure, value)"))
    # The lower edge of a bin names the bin.
    drop = "greatest(length(bin(value)) - 6, 0)"
    bins = values.groupBy(first, second, "measure", F.expr(f"shiftleft(shiftright(value, {drop}), {drop})").alias("edge")).agg(F.count("*").alias("n"))
    bins = written(bins, "sketches")
    tail, reach = (F.create_map(*[F.lit(x) for name, m in MEASURES.items() for x in (name, m[i])])[F.col("measure")] for i in (3, 4))

    def level(*keys: str) -> DataFrame:
        """The fences of one level by its own rows; its sketches are sums of those of the groups."""
        own = Window.partitionBy(*keys, "measure")
        merged = bins.groupBy(*keys, "measure", "edge").agg(F.sum("n").alias("n"))
        ranked = merged.withColumn("upto", F.sum("n").over(own.orderBy("edge"))).withColumn("all", F.sum("n").over(own))
        at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("all") * percent, F.col("edge")))
        out = ranked.groupBy(*keys, "measure").agg(F.max("all").alias("rows"), at(100 - tail).alias("down"), at(F.lit(50)).alias("mid"), at(tail).alias("up"))
        out = out.withColumn("reach", reach)
        top = lambda edge: f"({edge} + shiftleft(1L, greatest(length(bin({edge})) - 6, 0)) - 1)"  # noqa: E731  the largest value of a bin
        low, high = F.expr(f"greatest(mid - reach * ({top('mid')} - down) div 10, 0)"), F.expr(f"mid + reach * ({top('up')} - mid) div 10")
        return out.select(*keys, "measure", "rows", low.cast("long").alias("low"), high.cast("long").alias("high"))

    def weighed(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        up = above.select(*[F.col(k).alias(f"{k}_up") for k in keys], F.col("measure").alias("measure_up"), F.col("low").alias("low_up"), F.col("high").alias("high_up"))
        same = F.col("measure") == F.col("measure_up")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_up"))
        mixed = [F.expr(f"(rows * {c} + {prior} * {c}_up) div (rows + {prior})").alias(c) for c in ("low", "high")]
        return own.join(up, same).select(*[c for c in own.columns if c not in ("low", "high")], *mixed)

    by_first = weighed(level(first), level(), [])
    whole = weighed(level(first, second), by_first, [first])
    pick = lambda name, c: F.max(F.when(F.col("measure") == name, F.col(c))).alias(f"{name}_{c}")
    out = written(whole.groupBy(first, second).agg(F.max("rows").alias("rows"), *[pick(name, c) for name in MEASURES for c in ("low", "high")]), "fences")
    release(bins)
    return out


def _judged(docs: DataFrame, text_col: str, group: tuple[str, str], prior: int, keep: list[str], twice: bool) -> DataFrame:
    """row (a struct of keep), the counts, base_failed, failed and kept; counted again in place of being written with twice.

    Marked as nondeterministic, the counting is run once in each of the two passes and not again for a filter.
    """
    first, second = group
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    both = docs.select(row.alias("row"), F.col(f"`{first}`").alias("g1"), F.col(f"`{second}`").alias("g2"), F.pandas_udf(counts_of, COUNTS).asNondeterministic()(F.col(f"`{text_col}`")).alias("counts"))
    counted = both.select("row", "g1", "g2", "counts.*").withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    if not twice:
        counted = written(counted, "counted")
    limits = fences(counted.drop("row"), ("g1", "g2"), prior).withColumnsRenamed({"g1": "of1", "g2": "of2"}).drop("rows")
    judged = counted.join(limits, F.col("g1").eqNullSafe(F.col("of1")) & F.col("g2").eqNullSafe(F.col("of2")), "left")
    failed = []
    for name, (value, low, high, _, _) in MEASURES.items():
        out = F.lit(False)
        if low:
            out = out | (F.expr(value) < F.col(f"{name}_low"))
        if high:
            out = out | (F.expr(value) > F.col(f"{name}_high"))
        failed.append(F.when(out, F.lit(name)))
    judged = judged.withColumn("failed", F.array_compact(F.array(*failed)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_verdicts(docs: DataFrame, text_col: str = "text", group: tuple[str, str] = ("lang", "source"), prior: int = 200) -> DataFrame:
    """Each row of docs, but for the text, with the counts of its text, base_failed, kept and the names of failed measures.

    base_failed: fewer than 50 words, or over half of the words in three-word windows found twice
    or more. kept: not base_failed, and each measure within the fences of the row's group (fences());
    a value equal to its fence is within. A null or empty text has counts of 0 and fails. Null group
    values form a group of their own. Repeated rows are judged alike; no rows give no rows. Columns
    that clash with the made ones, in any case of letters, are replaced.
    """
    made = [c.split()[0] for c in COUNTS.split(", ")] + ["base_failed", "failed", "kept"]
    keep = [c for c in docs.columns if c != text_col]
    judged = _judged(docs, text_col, group, prior, keep, False)
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in keep if c.lower() not in made], *made)


def keep_passing(docs: DataFrame, text_col: str = "text", group: tuple[str, str] = ("lang", "source"), prior: int = 200) -> DataFrame:
    """The rows of docs that quality_verdicts() keeps, with all columns; texts are counted twice and never written."""
    judged = _judged(docs, text_col, group, prior, docs.columns, True).filter("kept")
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_verdicts(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LINES = "string_split(coalesce(text, ''), chr(10))"
_EDGE = "greatest(length(bin(value)) - 6, 0)"
_TOP = "({0} + (1::BIGINT << greatest(length(bin({0})) - 6, 0)) - 1)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter({_LINES}, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, [w[i + 1], w[i + 2], w[i + 3]] AS three FROM (SELECT r, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM d)),
x AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, three) AS often FROM g) WHERE often > 1) GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN x USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * word_chars // greatest(n_words, 1) AS word_length, 10000 * greatest(n_symbols - 1, 0) // greatest(word_chars, 1) AS symbols,
  10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 10000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM c),
v AS (SELECT lang, source, m.n AS measure, m.v AS value FROM (SELECT lang, source, unnest([{{'n': 'word_length', 'v': word_length}}, {{'n': 'symbols', 'v': symbols}}, {{'n': 'dup_lines', 'v': dup_lines}}, {{'n': 'repeats', 'v': repeats}}]) AS m FROM b WHERE NOT base_failed)),
e AS (SELECT lang, source, measure, ((value >> {_EDGE}) << {_EDGE}) AS edge FROM v),
l AS (SELECT 2 AS level, lang, source, measure, edge FROM e UNION ALL SELECT 1, lang, NULL, measure, edge FROM e UNION ALL SELECT 0, NULL, NULL, measure, edge FROM e),
h AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, measure ORDER BY edge) AS i, count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM l),
q AS (SELECT level, lang, source, measure, max(n) AS n, CASE WHEN measure IN ('word_length', 'symbols') THEN 90 ELSE 99 END AS tail, CASE WHEN measure IN ('word_length', 'symbols') THEN 50 ELSE 15 END AS reach,
  min(edge) FILTER (i * 100 >= n * (100 - (CASE WHEN measure IN ('word_length', 'symbols') THEN 90 ELSE 99 END))) AS down, min(edge) FILTER (i * 2 >= n) AS mid,
  min(edge) FILTER (i * 100 >= n * (CASE WHEN measure IN ('word_length', 'symbols') THEN 90 ELSE 99 END)) AS up FROM h GROUP BY level, lang, source, measure),
f AS (SELECT level, lang, source, measure, n, greatest(mid - reach * ({_TOP.format('mid')} - down) // 10, 0) AS low, mid + reach * ({_TOP.format('up')} - mid) // 10 AS high FROM q),
f1 AS (SELECT a.lang, a.measure, (a.n * a.low + 200 * z.low) // (a.n + 200) AS low, (a.n * a.high + 200 * z.high) // (a.n + 200) AS high FROM f a JOIN f z ON z.level = 0 AND z.measure = a.measure WHERE a.level = 1),
f2 AS (SELECT a.lang, a.source, a.measure, (a.n * a.low + 200 * z.low) // (a.n + 200) AS low, (a.n * a.high + 200 * z.high) // (a.n + 200) AS high
  FROM f a JOIN f1 z ON z.measure = a.measure AND z.lang IS NOT DISTINCT FROM a.lang WHERE a.level = 2),
k AS (SELECT lang, source, max(CASE WHEN measure = 'word_length' THEN low END) AS wl, max(CASE WHEN measure = 'word_length' THEN high END) AS wh, max(CASE WHEN measure = 'symbols' THEN high END) AS sh,
  max(CASE WHEN measure = 'dup_lines' THEN high END) AS dh, max(CASE WHEN measure = 'repeats' THEN high END) AS rh FROM f2 GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_length BETWEEN wl AND wh AND symbols <= sh AND dup_lines <= dh AND repeats <= rh, false) AS kept
FROM b LEFT JOIN k ON k.lang IS NOT DISTINCT FROM b.lang AND k.source IS NOT DISTINCT FROM b.source
"""
