"""Secret scans with corpus-wide ownership.

Spans that look like secrets are found in each text; their values leave the scan only as hashes.
For every hash the corpus is asked in how many repositories and under how many owners it occurs:
what many owners hold is an example, what few owners hold looks live, in however many of their
repositories. The base kinds are always
reported, each span with what the ownership says of its value. Spans of further kinds, which match
placeholders often, are added where the value is live.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import load, release, sha256_hex, written

#: kind -> (pattern, group that holds the value, least length of the value). The first three are the base.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
FURTHER = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 80),
    "bearer": (r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "forge": (r"gh[pousr]_[A-Za-z0-9]+", 0, 24),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    "pay": (r"[sr]k_(live|test)_[A-Za-z0-9]+", 0, 24),
    "url": (r"://[A-Za-z0-9._%-]{1,64}:([^/\s:@]+)@", 1, 8),
}
KINDS = [*BASE, *FURTHER]
_COMPILED = {k: (re.compile(p, re.A | (re.I if k == "assign" else 0)), g, n) for k, (p, g, n) in {**BASE, **FURTHER}.items()}
#: rank: the kind's place in KINDS; spans sort by start, then rank.
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
FOUND = f"base array<{SPAN}>, further array<struct<start:int,rank:int,kind:string,end:int,hash:string>>, hashes array<string>"


def spans_of(text: str | None) -> tuple[list, list, list]:
    """Base spans, further spans with the hash of their value, and the hashes of the base values."""
    base, further = [], []
    for rank, kind in enumerate(KINDS):
        pattern, group, least = _COMPILED[kind]
        for m in pattern.finditer(text or ""):
            if m.end(group) - m.start(group) >= least:
                value = hashlib.sha256(m.group(group).encode("utf-8", "replace")).hexdigest()
                (base if kind in BASE else further).append((m.start(), rank, kind, m.end(), value))
    base.sort()
    return [x[:4] for x in base], further, [x[4] for x in base]


def find_spans(text: pd.Series) -> pd.DataFrame:
    fields = ("start", "rank", "kind", "end", "hash")
    rows = []
    for x in text:
        base, further, hashes = spans_of(x)
        rows.append(([dict(zip(fields, b)) for b in base], [dict(zip(fields, f)) for f in further], hashes))
    return pd.DataFrame(rows, columns=["base", "further", "hashes"])


def ownership(candidates: DataFrame, max_owners: int = 2) -> DataFrame:
    """(hash, n_repositories, n_owners, live) for rows of (hash, repository, owner).

    Counts are of distinct values; a null repository or owner counts as one value of its own.
    Repeats are dropped before the shuffle, so a value copied everywhere is no hot key.
    """
    named = lambda c: F.struct(F.col(c).isNull().alias("unknown"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("name")).alias(c)
    pairs = candidates.select("hash", named("repository"), named("owner")).distinct()
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))
    return counts.withColumn("live", F.col("n_owners") <= max_owners)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _found(docs: DataFrame, text_col: str, repository_col: str, owner_col: str, max_owners: int, copy_text: bool, keep: list[str]) -> DataFrame:
    """row, kept, text (if copied), base, further, hashes and the live ones of the hashes asked for.

    Without the text all hashes are asked for; with it, only those of further kinds, so that rows
    without any, nearly all, never meet a join and no text is shuffled for them.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    found = docs.select(
        F.monotonically_increasing_id().alias("row"), kept.alias("kept"), *[F.col(f"`{text_col}`").alias("text")] * copy_text, F.col(f"`{repository_col}`").alias("repository"), F.col(f"`{owner_col}`").alias("owner"),
        F.pandas_udf(find_spans, FOUND)(F.col(f"`{text_col}`")).alias("found"),
    )
    found = written(found.select(*[c for c in found.columns if c != "found"], "found.*"), "secret-spans")
    values = F.transform("further", lambda s: s["hash"])
    values = values if copy_text else F.concat("hashes", values)
    seen = found.filter(F.size(values) > 0).select("row", "repository", "owner", F.explode(F.array_distinct(values)).alias("hash"))
    owned = written(ownership(seen, max_owners), "ownership")
    # A hash of very many texts is split by adaptive execution; lists are bounded by a text's own spans.
    live = seen.select("row", "hash").join(owned.filter("live").select("hash"), "hash", "left_semi")
    live = written(live.groupBy("row").agg(F.collect_set("hash").alias("live")), "live")
    release(owned)
    none = F.array().cast("array<string>")
    with_any = found.filter(F.size(values) > 0).join(live, "row", "left").withColumn("live", F.coalesce("live", none))
    return found.filter(F.size(values) == 0).withColumn("live", none).unionByName(with_any)


def _spans(base: str = "base", further: str = "further") -> Column:
    """Base spans and the live ones of further kinds, in the order of start and rank."""
    added = F.filter(further, lambda s: F.array_contains("live", s["hash"]))
    plain = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat(base, plain))


def secret_scan(docs: DataFrame, text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = 2) -> DataFrame:
    """Each row of docs, but for the text, with its spans; offsets are code points, the end exclusive.

    base and spans: arrays of (start, rank, kind, end) in the order of start and rank; spans are the
    base ones and the live ones of further kinds. owned: for each base span, in their order, live if at
    most max_owners owners hold its value, else copied; n_live, n_copied: how many are so. A null
    repository or owner counts as one of its own. A null or empty text has no spans. Repeated rows are
    scanned alike and count as one repository; no rows give no rows. Columns of docs that clash with the
    made ones, in any case of letters, are replaced.
    """
    made = ["base", "spans", "owned", "n_live", "n_copied"]
    keep = [c for c in docs.columns if c != text_col]
    joined = _found(docs, text_col, repository_col, owner_col, max_owners, False, keep)
    owned = F.transform("hashes", lambda h: F.when(F.array_contains("live", h), "live").otherwise("copied"))
    n = lambda word: F.size(F.filter("owned", lambda x: x == word)).cast("long").alias(f"n_{word}")
    result = joined.select("kept", "base", _spans().alias("spans"), owned.alias("owned")).select("kept", "base", "spans", "owned", n("live"), n("copied"))
    return result.select(*[F.col(f"kept.`{c}`").alias(c) for c in keep if c.lower() not in made], *made)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    texts = sha256_hex(spans_text(F.col("base"))).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), F.array_join("owned", ",").alias("owned")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), *texts, "n_live", "n_copied")


def redact(docs: DataFrame, text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source", max_owners: int = 2) -> DataFrame:
    """docs with each reported span of the text replaced by <kind>; a null text stays null, the other columns stay.

    Overlapping spans are replaced together, under the kind of the first. Empty texts, repeats and nulls
    are as in secret_scan(). Only rows with a span of a further kind meet the live hashes.
    """
    keep = [c for c in docs.columns if c != text_col]
    found = _found(docs, text_col, repository_col, owner_col, max_owners, True, keep).withColumn("spans", _spans())

    def cut(acc: Column, s: Column) -> Column:
        # Skip a span that begins inside the one before, but take its end.
        fresh = s["start"] >= acc["end"]
        piece = F.concat(F.substring(acc["text"], acc["end"] + 1, s["start"] - acc["end"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"), F.greatest(acc["end"], s["end"]).alias("end"), acc["text"].alias("text"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"), F.col("text").alias("text"))
    whole = F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(acc["text"], acc["end"] + 1, F.length(acc["text"]))))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])


def _sql() -> str:
    """Matches of each kind in order, then their places: the first occurrence after the match before."""
    anycase = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate({**BASE, **FURTHER}.items()):
        pattern = pattern.replace("'", "''").replace("(password|passwd|secret|token|api_?key)", f"({anycase})") if kind == "assign" else pattern.replace("'", "''")
        parts.append(f"SELECT r, {rank} AS rank, '{kind}' AS kind, {least} AS least, t, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS value FROM d")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE len(whole) > 0),
s AS (SELECT r, rank, kind, least, value, list_reduce(list_transform(whole, lambda w: [{{'w': w, 'start': 0::BIGINT, 'stop': 0::BIGINT}}]),
  lambda acc, x: list_append(acc, {{'w': x[1].w, 'start': acc[len(acc)].stop + instr(substring(t, acc[len(acc)].stop + 1), x[1].w) - 1, 'stop': acc[len(acc)].stop + instr(substring(t, acc[len(acc)].stop + 1), x[1].w) - 1 + length(x[1].w)}}),
  [{{'w': '', 'start': 0::BIGINT, 'stop': 0::BIGINT}}]) AS places FROM m),
p AS (SELECT r, rank, kind, places[i + 1].start AS start, places[i + 1].stop AS stop, value[i] AS value FROM (SELECT *, unnest(range(1, len(value) + 1)) AS i FROM s) WHERE length(value[i]) >= least),
o AS (SELECT value, count(DISTINCT (source IS NULL, coalesce(source, ''))) AS owners FROM p JOIN d USING (r) GROUP BY value),
k AS (SELECT p.*, rank < 3 AS base, owners <= 2 AS live FROM p JOIN o USING (value) WHERE rank < 3 OR owners <= 2),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (base) AS base,
  string_agg(CASE WHEN live THEN 'live' ELSE 'copied' END, ',' ORDER BY start, rank) FILTER (base) AS owned, count(*) FILTER (base AND live) AS n_live, count(*) FILTER (base AND NOT live) AS n_copied,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(owned, '') AS owned, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN a USING (r)
"""


ORACLE_SQL = _sql()
