"""Address functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Query keys that only track; a key matches if it begins with one of them.
TRACKING = r"(?i)^(utm_|ref|ref_src|fbclid|gclid|igshid|mc_cid|mc_eid|_hs)"


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_part(url, "HOST"), F.lit(""))), r"^www\.", "")


def _decoded(part: Column) -> Column:
    """A form-encoded name or value as text; what isn't well encoded stays, but for its plus signs."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def canonical_query(query: Column) -> Column:
    """A query's pairs written anew as forms are (a blank is a plus sign, a name alone has an empty value), without tracking keys."""
    named = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))).otherwise(F.lit(""))).alias("value"))
    pairs = F.transform(F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != ""), named)
    kept = F.filter(pairs, lambda p: ~p["name"].rlike(TRACKING))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")


def canonical_url(url: Column) -> Column:
    """Without fragment, www, port, user, tracking keys and last slash, the query written anew; what can't be parsed is only trimmed."""
    query = canonical_query(_part(url, "QUERY"))
    path = F.regexp_replace(F.coalesce(_part(url, "PATH"), F.lit("")), "/$", "")
    whole = F.concat(F.lower(_part(url, "PROTOCOL")), F.lit("://"), host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.coalesce(F.when(_part(url, "HOST").isNotNull(), whole), F.trim(url))


def normalize_host(host: Column) -> Column:
    """A host as people write it: without blanks, scheme, www, path, port and last dot, in lower case."""
    bare = F.regexp_replace(F.lower(F.trim(host)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[/?#:].*$", ""), r"^www\.", ""), r"\.$", "")


def is_safe(url: Column) -> Column:
    """Only http and https with a host."""
    return F.coalesce(F.lower(_part(url, "PROTOCOL")).isin("http", "https") & (_part(url, "HOST") != ""), F.lit(False))


def matches_domain(host: Column, domain: Column) -> Column:
    return (F.lower(host) == F.lower(domain)) | F.endswith(F.lower(host), F.concat(F.lit("."), F.lower(domain)))


def domain_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: suffix matches become an equi-join."""
    parts = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def stable_id(source: Column, external_id: Column, url: Column) -> Column:
    """source:external id, or the hash of the canonical address where there is no id."""
    from .text import fnv1a64

    own = F.when(F.trim(external_id) != "", external_id)
    return F.concat_ws(":", source, F.coalesce(own, F.lower(F.hex(fnv1a64(canonical_url(url))))))
