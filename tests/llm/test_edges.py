"""Nulls, empty and long texts, repeats, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe_codec, decontaminate, html_extract, jaccard_join, language_id, license_scan, quality_rules, secret_scan, token_counts, warc_archive

MIT = "This is under the MIT License, see below. MIT license!"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
ROWS = [(1, MIT, "en", "a"), (1, MIT, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, MIT, None, "b"), (4, LONG, "en", "b"), (5, "....", "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns named like what the operators make or use inside."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("row", "n_words", "kept", "spans", "hash", "words", "set", "n", "score", "labels", "base", "found", "live", "first", "class_id", "path", "text_", "g1", "failed", "a.b", "__found", "__row", "N_Words", "N_Tokens", "Score", "Decoded"):
        frame = frame.withColumn(c, F.lit("own"))
    return frame


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "mit license"), (None, "see below"), (3, None), (3, "")], "item_id long, text string")


CASES = {
    "license": lambda d, i: license_scan.license_scan(d),
    "tokens": lambda d, i: token_counts.token_counts(d),
    "quality": lambda d, i: quality_rules.quality_verdicts(d, prior=1),
    "benchmark": lambda d, i: decontaminate.contamination(d, i),
    "benchmark_blocks": lambda d, i: decontaminate.contamination(d, i, block=2),
    "clean": lambda d, i: decontaminate.drop_contaminated(d, i),
    "jaccard": lambda d, i: jaccard_join.jaccard_join(d),
    "secrets": lambda d, i: secret_scan.secret_scan(d),
    "redact": lambda d, i: secret_scan.redact(d),
    "bpe": lambda d, i: bpe_codec.bpe_encode(d),
    "decoded": lambda d, i: bpe_codec.bpe_decode(bpe_codec.bpe_encode(d)),
    "near": lambda d, i: jaccard_join.drop_near_copies(d),
    "language": lambda d, i: language_id.identify_language(d, *language_id.learn_prototypes(d)),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_edges(spark, docs, items, case):
    got = CASES[case](docs, items).collect()
    assert len(got) == {"clean": 4, "near": 5}.get(case, len(ROWS))
    assert len({c.lower() for c in got[0].asDict()}) == len(got[0].asDict())
    if case == "license":
        assert {(r.doc_id, r.n_base, r.first_word, r.last_word) for r in got} == {(1, 2, 4, 8), (None, 2, 4, 8), (2, 0, None, None), (3, 0, None, None), (4, 0, None, None), (5, 0, None, None)}
    if case.startswith("benchmark"):
        assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got} == {(1, 10, 6, 1, True), (None, 10, 6, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 60_000, 0, 0, False), (5, 0, 0, 0, False)}
    if case == "jaccard":
        assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in got) == [(0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0)]
        assert sum(r["first"] for r in got) == 5
    if case == "tokens":
        assert {r.doc_id: r.n_words for r in got}[4] == 60_000
    if case == "language":
        assert {r.doc_id: r.lang_pred for r in got} == {1: "en", None: "en", 2: "und", 3: "und", 4: "en", 5: "und"}
    if case == "decoded":
        assert {r.doc_id: r.decoded for r in got}[3] == "" and all(r.decoded.split(" ") == [x for x in r.decoded.split(" ") if x] for r in got if r.decoded)
    assert all(r["path"] == "own" and r["a.b"] == "own" for r in got)


def test_passing_rows(spark, docs):
    """Plain rows stay with all their columns; null, empty and short ones go, and so do texts that repeat themselves."""
    plain = [(100 + i, " ".join(f"word{(i * 7 + k) % 400} stands{k % 61}." for k in range(60 + i)), "en", "a") for i in range(40)]
    columns = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source")]
    more = spark.createDataFrame([*plain, (1, "again and again " * 60, "en", "a")], SCHEMA).select("*", *[F.lit("own").alias(c) for c in columns])
    got = quality_rules.keep_passing(docs.filter("doc_id IS NULL OR doc_id <> 4").unionByName(more)).collect()
    assert {r.doc_id for r in got} <= {p[0] for p in plain} and len(got) >= 36
    assert all(r["a.b"] == "own" and r.text for r in got)
    assert quality_rules.keep_passing(docs.limit(0)).count() == 0


def test_unknown_owners(spark):
    rows = [("h", "1", None), ("h", "2", ""), ("h", "3", "b"), ("g", None, None), ("g", None, None)]
    got = {r.hash: (r.n_repositories, r.n_owners, r.live) for r in secret_scan.ownership(spark.createDataFrame(rows, "hash string, repository string, owner string")).collect()}
    assert got == {"h": (3, 3, False), "g": (1, 1, True)}


@pytest.mark.parametrize("case", sorted(CASES))
def test_empty_tables(spark, docs, items, case):
    assert CASES[case](docs.limit(0), items.limit(0)).count() == 0


@pytest.mark.parametrize("case", ["benchmark", "clean"])
def test_empty_benchmark(spark, docs, items, case):
    assert CASES[case](docs, items.limit(0)).count() == len(ROWS)


PAGE = "<html><body><nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p>one <b>t</b>wo<p>three</article><footer>f</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    big = PAGE.replace("three", "x " * 900)
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", big), (3, None, big), (3, None, big), (None, "no url", big), (4, "http://a.example/4", None), (5, "http://a.example/ä\n", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("host", F.lit("own")).withColumn("digest", F.lit("own"))


def test_pages(spark, pages):
    got = {r.page_id: r for r in html_extract.extract_articles(pages).collect()}
    assert got[1].text == "T & U\none two\nthree" and got[1].n_chars == 19
    assert got[4].text == "" and got[5].text == "" and got[1].host == "own"
    assert html_extract.extract_articles(pages.limit(0)).count() == 0


def test_archives(spark, pages):
    got = warc_archive.read_archives(warc_archive.write_archives(pages), with_payload=True).collect()
    assert len(got) == 7
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 3), (1, "response", 0), (2, "revisit", 3), (3, "response", 0), (3, "response", 0), (4, "response", 0), (5, "response", 0)]
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.page_id == 1}[1] == PAGE
    assert warc_archive.read_archives(warc_archive.write_archives(pages.limit(0))).count() == 0
