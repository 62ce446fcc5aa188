"""Words of whole texts in Python workers against the expressions, and what is read how often."""

import math
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.functions import text, words
from tidewatch.operators import entities, fingerprints, topics
from tidewatch.operators.posts import top_tokens

TEXTS = [
    None, "", " - ' ", "Árbol, ¿sí? http://a.example/b’ö漢 ¡Ya!", "HTTPS://X.example y z https://b\x0bend", "İstanbul ſ K Å ệ ≮ ‘quoted’ “words” don't--stop -edge- it's", "étè a̸ ά Ⅷ 한국 🙂x",
    "tab\tline\r\nfeed\x0cform\x1cgap 7 77 777", "la la la morning morning evening " * 30, "ﬁn ạ̀b Ça straße œuvre",
]


def test_words_equal_the_expressions(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    both = rows.select("id", text.normalize_text(F.col("t")).alias("a"), words.normalized(F.col("t")).alias("b"), text.tokenize(F.col("t")).alias("c"), words.token_counts(F.col("t")).alias("d"), words.token_counts(F.col("t"), 1, ()).alias("e"), text.tokenize(F.col("t"), 1, ()).alias("f"))
    for r in both.collect():
        assert r.a == r.b
        for plain, counted in ((r.c, r.d), (r.f, r.e)):
            want = sorted(((t, (plain or []).count(t)) for t in set(plain or [])), key=lambda x: (-x[1], x[0]))
            assert [tuple(x) for x in counted] == want


def test_hash_bits_equal_the_expression(spark):
    rows = spark.createDataFrame([(1, "morning"), (2, "it's-fine"), (3, "abc" * 9)], "id int, body string")
    want = {r.id: r.h for r in rows.select("id", text.fnv1a64(F.col("body")).alias("h")).collect()}
    assert {r.id: r.simhash for r in fingerprints.simhash(rows).collect()} == want


def test_no_tokens_are_shuffled(spark):
    """A post's tokens stay in its row: its features, tokens and hash take no shuffle of rows of token."""
    at = datetime(2025, 1, 1, tzinfo=timezone.utc)
    posts = spark.createDataFrame([(i, at, "s", f"glacier melts {i % 7}00", ["e"]) for i in range(50)], "id long, published_at timestamp, source string, body string, entities array<string>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert all(word not in plan(topics.features(posts)) + plan(top_tokens(posts)) for word in ("Aggregate", "Join", "Window"))
    assert "Generate" not in plan(fingerprints.simhash(posts)) and "Join" not in plan(fingerprints.simhash(posts))


def test_rows_of_an_id_count_together(spark):
    at = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows = [("x", at, "s", "glacier melts", None), ("x", at, "s", "melts melts valley", None), ("y", at, "s", None, None), ("z", at, "s", "glacier glacier melts", None)]
    posts = spark.createDataFrame(rows, "id string, published_at timestamp, source string, body string, entities array<string>")
    assert sorted((r.id, r.token, r.n, r.place) for r in top_tokens(posts, 2).collect()) == [("x", "glacier", 1, 2), ("x", "melts", 3, 1), ("z", "glacier", 2, 1), ("z", "melts", 1, 2)]
    made = [(r.id, r.tokens, r.simhash) for r in topics.features(posts).collect()]
    joined = topics.features(spark.createDataFrame([("x", at, "s", "glacier melts melts melts valley", None)], posts.schema)).first()
    assert made.count(("x", ["melts", "glacier", "valley"], joined.simhash)) == 2 and ("y", [], 0) in made and len(made) == 4
    whole = topics.features(posts.filter("id <> 'x'"), "body", "source")
    assert {r.id: r.tokens for r in whole.collect()} == {"y": [], "z": ["glacier", "melts"]} and {r.simhash for r in whole.collect()} == {0}


def test_keywords_equal_those_of_all_tokens(spark):
    """What can't be among the first takes no part in the join and changes nothing."""
    rows = [(i, " ".join(f"w{(i * j) % 40:03d} " * (j % 9 + 1) for j in range(30)) + (" rare%d" % i) * (i % 4)) for i in range(1, 60)] + [(90, "few words"), (91, None)]
    posts = spark.createDataFrame(rows, "id int, body string")
    counts = {r.id: [(t.token, t.n) for t in r.t] for r in posts.select("id", words.token_counts(F.col("body")).alias("t")).collect()}
    df = {}
    for found in counts.values():
        for token, _ in found:
            df[token] = df.get(token, 0) + 1
    score = lambda t, n: round(n * (0.35 + 0.65 / (1 + math.log1p(df[t]))) + len(t) * 0.02, 9)
    want = {(i, t, p) for i, found in counts.items() for p, (t, _) in enumerate(sorted(found, key=lambda x: (-score(*x), x[0]))[:6], 1)}
    assert {(r.id, r.token, r.place) for r in fingerprints.top_keywords(posts).collect()} == want


def test_text_is_read_once_for_all_markers(spark):
    """detect_language() asks for two dozen markers of a text that one call has made."""
    plan = spark.createDataFrame([("a",)], "t string").select(F.coalesce(F.nullif("t", F.lit("a")), text.detect_language(F.col("t"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "translate" not in plan


def test_runs_begin_like_an_alias(spark):
    aliases = spark.createDataFrame([("two words", "a"), ("word", "b"), ("two", "c")], "alias string, slug string")
    posts = spark.createDataFrame([(1, "Two words and two wörds, two"), (2, "words two"), (3, None), (4, "two")], "id int, body string")
    assert {r.id: r.entities for r in entities.extract_entities(posts, aliases, F.col("body")).collect()} == {1: ["a", "c"], 2: ["c"], 4: ["c"]}
    starts = {2: frozenset(r.b for r in spark.range(1).select(words.bucket_of(F.lit("two")).alias("b")).collect())}
    assert {r.id: sorted(r.r) for r in posts.select("id", words.runs_of(F.col("body"), starts).alias("r")).collect()} == {1: ["two words"], 2: [], 3: [], 4: []}


def test_hashed_text_is_computed_once(spark):
    """An address is written anew once for its hash, not for each of its characters."""
    rows = spark.createDataFrame([("a",), (None,), ("",)], "t string")
    plan = rows.select(text.fnv1a64(F.concat("t", F.lit("x"))).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(") == 1
    assert [r.h for r in rows.select(text.hex64(text.fnv1a64(F.col("t"))).alias("h")).collect()] == ["af63dc4c8601ec8c", "cbf29ce484222325", "cbf29ce484222325"]


def test_only_keywords_leave_the_workers(spark):
    """Where tokens aren't asked for, features are as with them, and the first of equal counts are those by token."""
    at = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows = [(i, at, "s", " ".join(f"w{(i * j) % 13:02d}" * (1 + j % 7) for j in range(i)), None) for i in range(40)] + [(90, at, "s", None, None), (91, at, "s", " ".join(TEXTS[3:]), ["e"])]
    posts = spark.createDataFrame(rows, "id long, published_at timestamp, source string, body string, entities array<string>")
    few = topics.features(posts, whole=False)
    assert sorted(few.collect()) == sorted(topics.features(posts).drop("tokens").collect()) and "tokens" not in few.columns
    few, every = (posts.select("id", words.token_counts(F.col("body"), most=n).alias("t")).collect() for n in (3, None))
    assert [r.t for r in few] == [r.t[:3] for r in every] and max(len(r.t) for r in every) > 3


def test_hashes_of_many_words():
    made = [b"a", b"it's", b"x" * 32, b"y" * 33, b"z" * 1000, b"morning", b"even-ing"]
    assert words._fnvs(made) == [words._fnv(w) for w in made] and words._fnvs([]) == [] and words._fnvs([b"q" * 40]) == [words._fnv(b"q" * 40)]
