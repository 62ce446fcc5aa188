"""Queries of topics and outcomes: documents as posts, language and source as topics, line items as targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes, topics
from ..operators.posts import document_posts
from ..session import load, written
from .posts_sql import _BITS, _WHOLE


def _members(spark, sf_dir, whole=False):
    lang = F.coalesce("lang", F.lit("und"))
    posts = document_posts(spark, sf_dir).withColumn("entities", F.array(lang))
    return topics.features(posts, whole=whole).withColumn("topic", F.concat_ws(":", "source", F.get("entities", F.lit(0))))


def topic_rollup(spark, sf_dir):
    rows = topics.roll_up(_members(spark, sf_dir))
    return rows.select("topic", "posts", "corroborations", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), F.array_join("keywords", ",").alias("keywords"), "centroid")


def assigned_topics(spark, sf_dir):
    members = written(_members(spark, sf_dir, whole=True), "features")
    return topics.assign_topics(members, written(topics.roll_up(members), "topics")).select("id", "topic", F.round("score", 6).alias("score"))


def merged_topics(spark, sf_dir):
    return topics.merge_topics(written(topics.roll_up(_members(spark, sf_dir)), "topics"))


def opened_topics(spark, sf_dir):
    """Documents of which none has a topic yet, source and language being their entity."""
    posts = document_posts(spark, sf_dir).withColumn("entities", F.array(F.concat_ws(":", "source", F.coalesce("lang", F.lit("und")))))
    return topics.open_topics(written(topics.features(posts), "features"))


def line_outcomes(spark, sf_dir):
    """Orders as actions, their lines as targets."""
    status = F.when(F.col("l_returnflag") == "A", "SUCCESS").when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "O", "PENDING").otherwise("SKIPPED")
    return outcomes.action_outcomes(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("action"), status.alias("status")))


def archive_counts(spark, sf_dir):
    return outcomes.row_counts({n: load(spark, sf_dir, n) for n in ("documents", "events", "pages")})


QUERIES = {f.__name__: f for f in (topic_rollup, assigned_topics, merged_topics, opened_topics, line_outcomes, archive_counts)}

_TOPICS = f"""{_BITS}, m AS (SELECT id, ms, coalesce(lang, 'und') AS e, source || ':' || coalesce(lang, 'und') AS topic FROM d),
ph AS (SELECT id, sum(CASE WHEN on_ THEN (2::HUGEINT ** b)::HUGEINT ELSE 0 END)::HUGEINT AS s FROM v GROUP BY id), pw AS (SELECT id, {_WHOLE} AS h FROM (SELECT * FROM ph)),
p AS (SELECT m.*, coalesce(h, 0) AS h, coalesce(tokens, []) AS tokens FROM m LEFT JOIN pw USING (id) LEFT JOIN (SELECT id, list(token) AS tokens FROM k GROUP BY id) USING (id)),
cs AS (SELECT topic, sum(CASE WHEN on_ THEN (2::HUGEINT ** b)::HUGEINT ELSE 0 END)::HUGEINT AS s FROM (SELECT topic, b, 2 * sum(((h::HUGEINT + 18446744073709551616::HUGEINT) // (2::HUGEINT ** b)::HUGEINT) % 2) >= count(*) AS on_ FROM p, range(64) r(b) GROUP BY topic, b) GROUP BY topic),
cw AS (SELECT topic, {_WHOLE} AS centroid FROM (SELECT * FROM cs)),
k5 AS (SELECT id, token, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS pos FROM k QUALIFY pos <= 5),
kf AS (SELECT topic, token, min((ms, id, pos)) AS f FROM k5 JOIN m USING (id) GROUP BY topic, token),
kw AS (SELECT topic, list(token ORDER BY place) AS keywords FROM (SELECT topic, token, row_number() OVER (PARTITION BY topic ORDER BY f, token) AS place FROM kf QUALIFY place <= 8) GROUP BY topic),
t AS (SELECT topic, count(*) AS posts, min(ms) AS first_ms, max(ms) AS last_ms, any_value(e) AS e, any_value(coalesce(keywords, [])) AS keywords, any_value(centroid) AS centroid FROM p JOIN cw USING (topic) LEFT JOIN kw USING (topic) GROUP BY topic)"""
_SCORE = "round(0.4::DOUBLE * {0} + 0.25::DOUBLE * (1 - bit_count(xor({1}, {2}))::DOUBLE / 64) + 0.35::DOUBLE * ({3} = {4})::INT, 9)"
_OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0 ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END"


def _opened(rounds: int = 4) -> str:
    """All pairs of the posts left with the topics opened, in each round."""
    score, weight = _SCORE.format(_OVERLAP.format("p.tokens", "t.kw"), "p.h", "t.h", "p.e", "t.e"), "len(list_intersect(p.tokens, t.kw)) + 3 * (p.e = t.e)::INT"
    made = ["l0 AS MATERIALIZED (SELECT p.id, ms, topic AS e, h, tokens, coalesce(kw, []) AS kw FROM p LEFT JOIN (SELECT id, list(token ORDER BY pos) AS kw FROM k5 GROUP BY id) USING (id))"]
    for i in range(rounds):
        made += [
            f"o{i} AS MATERIALIZED (SELECT id AS topic, ms, e, h, kw FROM l{i} JOIN (SELECT w AS id, count(*) AS words FROM (SELECT arg_min(id, (ms, id)) AS w FROM (SELECT id, ms, unnest(kw) AS t FROM l{i}) GROUP BY t) GROUP BY w) USING (id)"
            f" WHERE 2 * words >= len(kw) AND id IN (SELECT arg_min(id, (ms, id)) FROM l{i} GROUP BY e))",
            f"c{i} AS (SELECT p.id, t.topic, p.ms - t.ms AS idle, {score} AS score FROM l{i} p, o{i} t WHERE {weight} > 0 AND p.id NOT IN (SELECT topic FROM o{i}) QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {weight} DESC, t.topic) <= 24)",
            f"j{i} AS MATERIALIZED (SELECT topic AS id, topic FROM o{i} UNION ALL SELECT * FROM (SELECT id, topic FROM c{i} WHERE idle <= 21600000 AND score >= 0.45 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) = 1))",
            f"l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE id NOT IN (SELECT id FROM j{i}))",
        ]
    return ", ".join(made) + " " + " UNION ALL ".join([f"SELECT id, topic FROM j{i}" for i in range(rounds)] + [f"SELECT id, id AS topic FROM l{rounds}"])


ORACLES = {
    "opened_topics": f"WITH {_TOPICS}, {_opened()}",
    "topic_rollup": f"WITH {_TOPICS} SELECT topic, posts, 0::BIGINT AS corroborations, first_ms, last_ms, array_to_string(keywords, ',') AS keywords, centroid FROM t",
    "assigned_topics": f"""WITH {_TOPICS}, c AS (SELECT p.id, t.topic, p.ms - last_ms AS idle, {_SCORE.format(_OVERLAP.format('p.tokens', 't.keywords'), 'p.h', 't.centroid', 'p.e', 't.e')} AS score, len(list_intersect(tokens, keywords)) + 3 * (p.e = t.e)::INT AS weight FROM p, t WHERE weight > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, topic) AS place FROM c QUALIFY place <= 24), b AS (SELECT id, topic, score FROM r WHERE idle <= 21600000 AND score >= 0.45 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) = 1)
SELECT p.id, b.topic, round(score, 6) AS score FROM p LEFT JOIN b USING (id)""",
    "merged_topics": f"""WITH RECURSIVE {_TOPICS}, l AS (SELECT a.topic AS a, b.topic AS b FROM t a, t b WHERE a.topic <> b.topic AND {_SCORE.format(_OVERLAP.format('a.keywords', 'b.keywords'), 'a.centroid', 'b.centroid', 'a.e', 'b.e')} >= 0.62),
r AS (SELECT topic AS x, topic AS c FROM t UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x) SELECT x AS topic, min(c) AS merged FROM r GROUP BY x""",
    "line_outcomes": """SELECT *, success > 0 AND failed > 0 AS partial, CASE WHEN pending + running > 0 THEN 'OPEN' WHEN success > 0 THEN 'SUCCESS' ELSE 'FAILED' END AS overall FROM (SELECT l_orderkey AS action, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS success, count(*) FILTER (l_returnflag = 'R') AS failed,
  count(*) FILTER (l_returnflag NOT IN ('A', 'R') AND l_linestatus <> 'O') AS skipped, count(*) FILTER (l_returnflag NOT IN ('A', 'R') AND l_linestatus = 'O') AS pending, 0::BIGINT AS running FROM lineitem GROUP BY 1)""",
    "archive_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in ("documents", "events", "pages")),
}
