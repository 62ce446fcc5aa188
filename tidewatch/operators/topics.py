"""Topics: posts join the topic they resemble or open one, twins are merged, idle ones leave.

A post has id, published_at, source, tokens (distinct), keywords (its five most frequent tokens),
entities and simhash; a topic has topic, keywords, entities, centroid and last_seen.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import jaccard, simhash_similarity
from ..functions.words import token_counts
from ..session import release, written
from .fingerprints import assembled, centroids, simhash, simhash_of
from .posts import has_repeats, post_tokens

ACTIVE_MS = 6 * 3_600_000
JOIN_AT, MERGE_AT = 0.45, 0.62
KEYWORDS, TOPIC_KEYWORDS, TOPIC_ENTITIES = 5, 8, 12


def features(posts: DataFrame, text: str = "body", hash_text: str | None = None, whole: bool = True) -> DataFrame:
    """posts (id, published_at, source, entities) with what topics look at; a post without tokens has empty ones and simhash 0.

    Simhashes may be of another text than tokens and keywords, such as one with the title twice. With whole=False tokens are
    left out, as for roll_up(), which doesn't look at them: only keywords leave the workers then.
    """
    most = None if whole else KEYWORDS
    none = F.array().cast("array<string>")
    own = ["id", "published_at", "source", F.coalesce("entities", none).alias("entities")]
    if has_repeats(posts):
        tokens = post_tokens(posts, text).select("id", F.col("t.token").alias("tokens"), F.slice("t.token", 1, KEYWORDS).alias("keywords"))
        both = posts.select(*own).join(tokens, "id", "left").join(simhash(posts, hash_text or text), "id", "left")
    else:  # all that is asked of a post is in its row
        hashed = token_counts(F.col(hash_text or text), votes=True, counts=not hash_text, most=most).alias("h")
        rows = posts.select(*own, hashed, *([token_counts(F.col(text), most=most).alias("t")] if hash_text else []))
        rows = rows.withColumns({"t": F.col("t" if hash_text else "h.counts"), "n": F.col("h.n"), "votes": F.col("h.votes")})
        both = rows.select("id", "published_at", "source", "entities", F.col("t.token").alias("tokens"), F.slice("t.token", 1, KEYWORDS).alias("keywords"), simhash_of("n", "votes").alias("simhash"))
    made = both.withColumns({"tokens": F.coalesce("tokens", none), "keywords": F.coalesce("keywords", none), "simhash": F.coalesce("simhash", F.lit(0))})
    return made if whole else made.drop("tokens")


def similarity(words: tuple[Column, Column], hashes: tuple[Column, Column], entities: tuple[Column, Column]) -> Column:
    return _score(jaccard(*words), hashes, jaccard(*entities))


def _score(words: Column, hashes: tuple[Column, Column], entities: Column) -> Column:
    """Rounded, so that equal scores are equal in whatever order they are summed."""
    return F.round(0.4 * words + 0.25 * simhash_similarity(*hashes) + 0.35 * entities, 9)


def _terms(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, kind, term): words and entities of each row."""
    of = lambda kind, c: rows.select(key, F.lit(kind).alias("kind"), F.explode(F.array_distinct(c)).alias("term"))
    return of(1, words).union(of(3, "entities"))


#: Topics of each term, those that can weigh most, whose weights give a post's bound.
FIRST_LOOK = 64


def _first_places(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` topics of each term; tasks sort out the others before the shuffle."""
    place = F.row_number().over(Window.partitionBy("kind", "term").orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("kind", "term", "topic")


def _from_rarest(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Terms of each row with rest, the weight of the term and of the row's commoner ones."""
    later = Window.partitionBy(key).orderBy("df", "kind", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.join(counts, ["kind", "term"]).withColumn("rest", F.sum("kind").over(later)).drop("df")


def candidate_pairs(posts: DataFrame, topics: DataFrame, most: int = 24, look: int = FIRST_LOOK) -> DataFrame:
    """Distinct (id, topic) that hold each post's best `most` topics by shared terms, ties by topic, and few others.

    Terms are ordered by rarity among topics. A post and a topic that meet first by a term weigh no more than the
    rest of either from that term on. The weights of some promising topics of each term give a bound: the
    `most`-th largest of a post is what a topic must be able to reach, and postings that can't are not joined. Where the
    term is the last of either, all weigh its weight, and of these the least `most` topics by name are enough.
    """
    named = F.coalesce(F.concat(F.lit("="), "term"), F.lit(""))  # a null is a term as well
    terms = _terms(topics, "topic", "keywords").withColumn("term", named)
    counts = written(terms.groupBy("kind", "term").agg(F.count("*").alias("df")), "term-counts")
    placed = written(_from_rarest(terms, counts, "topic"), "postings")
    own = written(_from_rarest(_terms(posts, "id", "tokens").withColumn("term", named), counts, "id"), "post-terms")
    some = _first_places(placed, [F.desc("rest"), "topic"], look)
    known = _weighed(own.select("id", "kind", "term").join(some, ["kind", "term"]).select("id", "topic").distinct(), posts, topics)
    bound = known.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight")))).filter(F.col("place") == most).select("id", F.col("weight").alias("bound"))
    last = _first_places(placed.filter("rest = kind"), ["topic"], most).withColumns({"of_last": F.lit(True), "of_all": F.lit(False)})
    least = _first_places(placed, ["topic"], most).withColumns({"of_last": F.lit(False), "of_all": F.lit(True)})
    flags = last.union(least).groupBy("kind", "term", "topic").agg(F.max("of_last").alias("of_last"), F.max("of_all").alias("of_all"))
    lists = placed.join(flags, ["kind", "term", "topic"], "left").filter("rest > kind OR of_last OR of_all").alias("l")
    bounded = own.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(0))).alias("p")
    same = (F.col("p.kind") == F.col("l.kind")) & (F.col("p.term") == F.col("l.term")) & (F.col("p.rest") >= F.col("p.bound")) & (F.col("l.rest") >= F.col("p.bound"))
    enough = F.expr("CASE WHEN p.rest = p.kind THEN coalesce(l.of_all, false) WHEN l.rest = l.kind THEN coalesce(l.of_last, false) ELSE true END")
    found = written(bounded.join(lists, same & enough).select("p.id", "l.topic").distinct(), "candidate-pairs")
    release(counts, placed, own)
    return found


def _sizes() -> dict[str, Column]:
    """What a score asks of a post besides the terms it shares."""
    count = lambda c: F.size(F.array_distinct(c))
    return {"now": F.unix_millis("published_at"), "simhash": F.col("simhash"), "n_tokens": count("tokens"), "n_own": count("entities")}


def _sized(posts: DataFrame) -> DataFrame:
    return posts.select("id", *[v.alias(c) for c, v in _sizes().items()])


def _weighed(pairs: DataFrame, posts: DataFrame, topics: DataFrame) -> DataFrame:
    """pairs (id, topic) with the sizes of the post, how many words and things both have, and weight."""
    rows = posts.withColumns(_sizes()).select("id", *_sizes(), "tokens", "entities")
    both = pairs.join(rows, "id").join(topics.select("topic", "keywords", F.col("entities").alias("about")), "topic")
    common = {"words": F.size(F.array_intersect("tokens", "keywords")), "things": F.size(F.array_intersect("entities", "about"))}
    return _with_weight(both.withColumns(common).select("id", *_sizes(), "topic", *common))


def _with_weight(rows: DataFrame) -> DataFrame:
    return rows.withColumn("weight", (F.col("words") + 3 * F.col("things")).cast("long"))


def _all_met(posts: DataFrame, sized: DataFrame, topics: DataFrame) -> DataFrame:
    """Like _weighed(), for all pairs with a common term of posts whose ids are in sized, each once.

    Terms that no topic has leave where the post is read, so that its tokens are neither shuffled nor repeated for each pair;
    the others are shuffled once, by id, and pairs stay in that task.
    """
    listed = _terms(topics, "topic", "keywords").alias("l")
    same = (F.col("p.kind") == F.col("l.kind")) & F.col("p.term").eqNullSafe(F.col("l.term"))
    own = _terms(posts, "id", "tokens").alias("p").join(listed, same, "left_semi").repartition("id")
    met = own.alias("p").join(listed, same).groupBy("p.id", "l.topic").agg(F.count_if(F.col("p.kind") == 1).alias("words"), F.count_if(F.col("p.kind") == 3).alias("things"))
    return _with_weight(met.join(sized, "id"))


def _few_share(topics: DataFrame, look: int) -> bool:
    """Whether no term has more than `look` topics; then their number bounds the pairs of a post as well as a first look does."""
    return _terms(topics, "topic", "keywords").groupBy("kind", "term").count().filter(F.col("count") > look).isEmpty()


def _best(posts: DataFrame, topics: DataFrame, active_ms: int, most: int, look: int = FIRST_LOOK, sized: DataFrame | None = None, repeats: bool | None = None) -> DataFrame:
    """The `most` best pairs of each post, without those idle for too long. sized: posts to be looked at, if not all."""
    if not (has_repeats(posts) if repeats is None else repeats) and _few_share(topics, look):
        met = _all_met(posts, _sized(posts) if sized is None else sized, topics)
    else:
        held = posts if sized is None else written(posts.join(sized.select("id"), "id", "left_semi"), "held-posts")
        met = _weighed(candidate_pairs(held, topics, most, look), held, topics)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "topic"))
    best = met.withColumn("place", place).filter(F.col("place") <= most)
    return best.join(topics.select("topic", F.unix_millis("last_seen").alias("seen")), "topic").filter(F.col("now") - F.col("seen") <= active_ms)


def candidate_topics(posts: DataFrame, topics: DataFrame, active_ms: int = ACTIVE_MS, most: int = 24, look: int = FIRST_LOOK) -> DataFrame:
    """(id, topic, weight): the topics that share most with a post, a token counting one, an entity three.

    The best `most` are taken first, then those idle for too long go. posts and topics are read several times and should be written.
    """
    return _best(posts, topics, active_ms, most, look).select("id", "topic", "weight")


def _overlap(common: str, a: str, b: str) -> Column:
    """jaccard() from sizes."""
    n = F.col(common)
    return F.when((F.col(a) > 0) & (F.col(b) > 0), n / (F.col(a) + F.col(b) - n)).otherwise(F.lit(0.0))


def _assigned(posts: DataFrame, topics: DataFrame, join_at: float, active_ms: int, most: int, sized: DataFrame | None = None, repeats: bool | None = None) -> DataFrame:
    """(id, topic, score) of the posts that join a topic."""
    count = lambda c: F.size(F.array_distinct(c))
    pairs = _best(posts, topics, active_ms, most, sized=sized, repeats=repeats)
    pairs = pairs.join(topics.select("topic", "centroid", count("keywords").alias("n_keywords"), count("entities").alias("n_about")), "topic")
    score = _score(_overlap("words", "n_tokens", "n_keywords"), (F.col("simhash"), F.col("centroid")), _overlap("things", "n_own", "n_about"))
    best = pairs.withColumn("score", score).filter(F.col("score") >= join_at).groupBy("id").agg(F.min_by(F.struct("topic", "score"), F.struct((-F.col("score")).alias("s"), F.col("topic"))).alias("b"))
    return best.select("id", "b.*")


def assign_topics(posts: DataFrame, topics: DataFrame, join_at: float = JOIN_AT, active_ms: int = ACTIVE_MS, most: int = 24) -> DataFrame:
    """(id, topic, score): each post with its best topic; both are null if none scores join_at. Ties go to the least topic."""
    return posts.select("id").join(_assigned(posts, topics, join_at, active_ms, most), "id", "left")


def keep_known(posts: DataFrame, assigned: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, topic) of posts whose topic is alive, and the posts that are to be assigned."""
    alive = assigned.select("id", "topic").join(topics.select("topic"), "topic", "left_semi")
    return posts.select("id").join(alive, "id").select("id", "topic"), posts.join(alive.select("id"), "id", "left_anti")


def active_topics(topics: DataFrame, now_ms: int, active_ms: int = ACTIVE_MS) -> DataFrame:
    return topics.filter(F.lit(now_ms) - F.unix_millis("last_seen") <= active_ms)


def _first_terms(members: DataFrame, column: str, most: int) -> DataFrame:
    """The first distinct terms of each topic in order of arrival, few rows of a topic meeting in a task."""
    terms = members.select("topic", "published_at", "id", F.posexplode(column).alias("at", "term"))
    first = terms.groupBy("topic", "term").agg(F.min(F.struct("published_at", "id", "at")).alias("first"))
    best = first.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("first", "term"))).filter(F.col("place") <= most)
    return best.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t")).select("topic", F.col("t.term").alias(column))


def roll_up(members: DataFrame) -> DataFrame:
    """One row for each topic of members (posts with features and topic); a repeated post counts as corroboration.

    Posts are written once, without their tokens, as four readings follow.
    """
    once = members.groupBy("topic", "id").agg(F.count("*").alias("n"), F.min_by(F.struct("published_at", "source", "keywords", "entities", "simhash"), "published_at").alias("p"), F.max("published_at").alias("seen"))
    once = written(once.select("topic", "id", "n", "seen", "p.*"), "members")
    whole = once.groupBy("topic").agg(
        F.count("*").alias("posts"), (F.sum("n") - F.count("*")).alias("corroborations"), F.min("published_at").alias("first_seen"), F.max("seen").alias("last_seen"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    none = F.array().cast("array<string>")
    out = whole.join(centroids(once), "topic").join(_first_terms(once, "keywords", TOPIC_KEYWORDS), "topic", "left").join(_first_terms(once, "entities", TOPIC_ENTITIES), "topic", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("keywords", "entities")})


def topic_states(members: DataFrame) -> DataFrame:
    """Like roll_up(), in a form that merge_states() can add to: first terms with their place, and sums of the simhashes' bits."""
    once = members.groupBy("topic", "id").agg(F.count("*").alias("n"), F.min_by(F.struct("published_at", "source", "keywords", "entities", "simhash"), "published_at").alias("p"), F.max("published_at").alias("seen"))
    once = once.select("topic", "id", "n", "seen", "p.*")
    bits = F.array(*[F.sum(F.bit_get("simhash", F.lit(b)).cast("long")) for b in range(64)])
    whole = once.groupBy("topic").agg(
        F.count("*").alias("posts"), (F.sum("n") - F.count("*")).alias("corroborations"), F.min("published_at").alias("first_seen"), F.max("seen").alias("last_seen"), F.array_sort(F.collect_set("source")).alias("sources"), bits.alias("bits"),
    )

    def firsts(column: str, most: int) -> DataFrame:
        terms = once.select("topic", "published_at", "id", F.posexplode(column).alias("at", "term")).groupBy("topic", "term").agg(F.min(F.struct("published_at", "id", "at")).alias("first"))
        best = terms.withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("first", "term"))).filter(F.col("place") <= most)
        return best.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("first", "term"))).alias(column))

    out = whole.join(firsts("keywords", TOPIC_KEYWORDS), "topic", "left").join(firsts("entities", TOPIC_ENTITIES), "topic", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("keywords", "entities")})


def merge_states(*states: DataFrame) -> DataFrame:
    """One state for each topic of states over different posts. A term that is among the first of all is among those of its batch."""
    both = states[0]
    for more in states[1:]:
        both = both.unionByName(more)

    def firsts(column: str, most: int) -> Column:
        terms = F.array_sort(F.flatten(F.collect_list(column)))
        return F.slice(F.filter(terms, lambda x, i: F.array_position(F.transform(terms, lambda t: t["term"]), x["term"]) == i + 1), 1, most)

    sums = [F.sum(F.get("bits", F.lit(b))).alias(f"b{b}") for b in range(64)]
    merged = both.groupBy("topic").agg(
        F.sum("posts").alias("posts"), F.sum("corroborations").alias("corroborations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), firsts("keywords", TOPIC_KEYWORDS).alias("keywords"), firsts("entities", TOPIC_ENTITIES).alias("entities"), *sums,
    )
    return merged.select("topic", "posts", "corroborations", "first_seen", "last_seen", "sources", F.array(*[F.col(f"b{b}") for b in range(64)]).alias("bits"), "keywords", "entities")


def topics_of(states: DataFrame) -> DataFrame:
    """What roll_up() says of the posts that the states stand for."""
    centroid = assembled([F.get("bits", F.lit(b)) * 2 >= F.col("posts") for b in range(64)])
    terms = {c: F.transform(c, lambda t: t["term"]) for c in ("keywords", "entities")}
    return states.select("topic", "posts", "corroborations", "first_seen", "last_seen", "sources", centroid.alias("centroid"), *[v.alias(c) for c, v in terms.items()])


def _openers(posts: DataFrame) -> DataFrame:
    """Posts that are the earliest with at least half of their keywords and with their set of entities; of any posts with keywords there is one."""
    words = F.transform("keywords", lambda k: F.struct(F.lit("k").alias("kind"), F.xxhash64(k).alias("term")))
    together = F.when(F.size("entities") > 0, F.array(F.struct(F.lit("e").alias("kind"), F.xxhash64(F.array_join(F.array_sort("entities"), "\n")).alias("term"))))
    terms = posts.select("id", "published_at", F.explode(F.concat(words, F.coalesce(together, F.slice(words, 1, 0)))).alias("t"))
    firsts = terms.groupBy("t").agg(F.min(F.struct("published_at", "id")).alias("first")).groupBy("first.id").agg(F.count_if(F.col("t.kind") == "k").alias("words"), F.count_if(F.col("t.kind") == "e").alias("sets"))
    return posts.join(firsts, "id").filter("size(keywords) > 0 AND 2 * words >= size(keywords) AND (size(entities) = 0 OR sets > 0)").drop("words", "sets")


def open_topics(posts: DataFrame, rounds: int = 4, join_at: float = JOIN_AT, active_ms: int = ACTIVE_MS) -> DataFrame:
    """(id, topic) for posts that no topic took; a topic bears the id of the post that opened it.

    In each round the posts that come before others with their words open topics and the others join
    the topic they resemble most; what joins none goes on to the next round. After the last round each post
    left opens its own, and merge_topics unites twins. Work grows with the posts: no pairs of posts
    with a common word are made. posts are read in each round and should be written; what is left of them is
    written without their tokens.
    """
    repeats, out, made = has_repeats(posts), None, []
    left = posts.withColumns(_sizes()).select("id", "published_at", "keywords", "entities", *_sizes())
    for step in range(rounds):
        opened = _openers(left).select(F.col("id").alias("topic"), "keywords", "entities", F.col("simhash").alias("centroid"), F.col("published_at").alias("last_seen"))
        opened = written(opened, f"opened-{step}")
        rest = left.join(opened.select(F.col("topic").alias("id")), "id", "left_anti").select("id", *_sizes())
        joined = _assigned(posts, opened, join_at, active_ms, 24, rest, repeats).select("id", "topic")
        done = written(joined.union(opened.select(F.col("topic").alias("id"), "topic")), f"joined-{step}")
        out = done if out is None else out.union(done)
        left = written(left.join(done.select("id"), "id", "left_anti"), f"left-{step}")
        made += [opened, done, left]
        if left.isEmpty():
            break
    own = left.select("id", F.col("id").alias("topic"))
    found = written(own if out is None else out.union(own), "open-topics")
    release(*made)
    return found


def _reach(merge_at: float, base: float) -> int:
    """Bits in which two centroids may differ for topics whose words and entities give `base` to score merge_at; below 0 none."""
    return math.floor(64 * (1 - (merge_at - base) / 0.25) + 1e-6)


def _bands(key: tuple, differing: int, most: int = 8) -> list[tuple]:
    """(*key, band, shift, mask): spans of bits of which two hashes that differ in so many share one; one span of no bits beyond `most`."""
    if differing < 0:
        return []
    n = differing + 1
    if n > most:
        return [(*key, 0, 0, 0)]
    cuts = [64 * i // n for i in range(n + 1)]
    return [(*key, i, lo, (1 << (hi - lo)) - 1 if hi - lo < 64 else -1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]


#: Classes that a block may hold before finer blocks take its place.
LARGE_BLOCK = 256


def _candidates(nodes: DataFrame, merge_at: float, large: int) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b), a < b: classes that may hold twins, and nodes whose centroids may make them twins.

    Without a common entity twins have equal keywords; with one they have a keyword in common too. So classes meet by all
    their keywords, or by a keyword and an entity. Where more than `large` classes meet, finer blocks find the same twins: two keywords
    and the entity, or, as one common keyword leaves little room, the entity, both sizes and a span of the centroid's bits
    in which the two must agree. Nodes, not classes, meet by such spans.
    """
    spark, bits = nodes.sparkSession, "shiftrightunsigned(centroid, shift) & mask"
    sized = nodes.withColumn("size", F.least(F.size("keywords"), F.lit(TOPIC_KEYWORDS)))
    whole = nodes.filter("size(keywords) > 0").select("class", "node", "centroid", F.xxhash64(F.array_join("keywords", "\n")).alias("block"))
    both = sized.select("class", "node", "centroid", "size", "keywords", F.explode("keywords").alias("k"), "entities").withColumn("e", F.explode("entities")).drop("entities")
    both = both.withColumn("block", F.xxhash64("k", "e"))

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of small and of large blocks; few rows of a block leave each task."""
        held = rows.groupBy("block", "class").count().groupBy("block").agg((F.count("*") > large).alias("large"))
        told = rows.join(held, "block")
        return told.filter("NOT large"), told.filter("large")

    few, many = split(whole)
    rooms = spark.createDataFrame(_bands((), _reach(merge_at, 0.4)) or [(0, 0, 0)], "band int, shift int, mask long")
    near = many.crossJoin(F.broadcast(rooms)).select("node", F.xxhash64("block", "band", F.expr(bits)).alias("block"), F.lit(0).alias("side"))  # eight rows at most
    few_both, many = split(both)
    sizes = range(1, TOPIC_KEYWORDS + 1)
    made = [row for p in sizes for q in sizes for row in _bands((p, min(p, q), max(p, q)), _reach(merge_at, 0.35 + 0.4 / (p + q - 1)))]
    rooms = spark.createDataFrame(made, "size int, low int, high int, band int, shift int, mask long")
    side = F.when(F.col("low") == F.col("high"), 0).when(F.col("size") == F.col("low"), 1).otherwise(2)  # of unequal sizes each meets the other only
    sized = many.join(F.broadcast(rooms), "size").select("class", "node", "mask", F.xxhash64("block", "low", "high", "band", F.expr(bits)).alias("block"), side.alias("side"))  # rows by sizes alone
    second = many.withColumn("other", F.explode("keywords")).filter("other <> k")
    second = second.select("class", F.xxhash64(F.least("k", "other"), F.greatest("k", "other"), "e").alias("block"), F.lit(0).alias("side"))
    of_classes = [few.select("class", "block", F.lit(0).alias("side")), few_both.select("class", "block", F.lit(0).alias("side")), second, sized.filter("mask = 0").select("class", "block", "side")]

    def met(rows: DataFrame, label: str) -> DataFrame:
        blocks = written(rows.toDF("a", "block", "side").distinct(), f"{label}-blocks")
        other = blocks.select("block", F.col("a").alias("b"), F.col("side").alias("other"))
        found = written(blocks.join(other, "block").filter("a < b AND (side = 0 OR side <> other)").select("a", "b").distinct(), f"{label}-pairs")
        release(blocks)
        return found

    return met(reduce(DataFrame.union, of_classes), "class"), met(near.union(sized.filter("mask <> 0").select("node", "block", "side")), "node")


def twin_links(topics: DataFrame, merge_at: float = MERGE_AT, large: int = LARGE_BLOCK) -> DataFrame:
    """(a, b): links between topics that connect just those that pairs scoring merge_at or more connect.

    Topics of equal keywords and entities are one class, if these alone make them twins; topics that also have equal centroids are one
    node. Members are linked to the least of their class, and classes are compared instead of topics: by words and entities alone where
    these decide, by their nodes' centroids where they don't. Two classes with two words in common that neither surely are
    twins nor surely aren't are compared node by node.
    """
    if not 0.61 <= merge_at <= 0.75:
        raise ValueError("below 0.61 topics may be twins that share no block, above 0.75 equal words and entities don't make twins")
    none = F.array().cast("array<string>")
    folded = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    own = topics.select("topic", folded(F.col("keywords")).alias("keywords"), folded(F.col("entities")).alias("entities"), "centroid")
    words, about = F.size("keywords") > 0, F.size("entities") > 0
    nodes = own.groupBy("keywords", "entities", "centroid").agg(F.min("topic").alias("node"))
    least = nodes.filter(words & about).groupBy("keywords", "entities").agg(F.min("node").alias("class"))
    nodes = written(nodes.join(least, ["keywords", "entities"], "left").withColumn("class", F.coalesce("class", "node")), "twin-nodes")
    equal = own.join(nodes, ["keywords", "entities", "centroid"]).filter(words & (about | F.lit(merge_at <= 0.65)) & (F.col("topic") != F.col("node")))
    links = [equal.select(F.col("node").alias("a"), F.col("topic").alias("b")), nodes.filter("class <> node").select(F.col("class").alias("a"), F.col("node").alias("b"))]
    pairs, close = _candidates(nodes, merge_at, large)
    classes = nodes.filter("class = node").select("class", "keywords", "entities")
    of = lambda side: classes.select(F.col("class").alias(side), F.struct("keywords", "entities").alias(f"{side}_is"))
    base = similarity((F.col("a_is.keywords"), F.col("b_is.keywords")), (F.lit(0), F.lit(-1)), (F.col("a_is.entities"), F.col("b_is.entities")))
    rated = written(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", base.alias("base")).filter(F.col("base") + 0.25 >= merge_at - 1e-9), "rated-classes")
    links.append(rated.filter(F.col("base") >= merge_at).select("a", "b"))
    node = lambda side: nodes.select(F.col("class").alias(side), F.struct("node", "keywords", "centroid", "entities").alias(f"{side}_is"))
    columns = [(F.col(f"a_is.{c}"), F.col(f"b_is.{c}")) for c in ("keywords", "centroid", "entities")]
    near = rated.filter(F.col("base") < merge_at).select("a", "b").join(node("a"), "a").join(node("b"), "b").filter(similarity(*columns) >= merge_at)
    links.append(near.select(F.col("a_is.node").alias("a"), F.col("b_is.node").alias("b")))
    own = lambda side: nodes.select(F.col("node").alias(side), F.struct("keywords", "centroid", "entities").alias(f"{side}_is"))
    links.append(close.join(own("a"), "a").join(own("b"), "b").filter(similarity(*columns) >= merge_at).select("a", "b"))
    found = written(reduce(DataFrame.union, links), "twin-links")
    release(nodes, pairs, close, rated)
    return found


def merge_topics(topics: DataFrame, merge_at: float = MERGE_AT, large: int = LARGE_BLOCK) -> DataFrame:
    """(topic, merged): every topic and the least topic of those it is one with, over all links.

    Each round takes the least label of a topic's neighbours and then the label of that label, so a chain
    of n topics takes about log n rounds.
    """
    pairs = twin_links(topics, merge_at, large)
    links = written(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "twins")
    release(pairs)
    labels = written(links.select(F.col("a").alias("topic")).distinct().withColumn("merged", F.col("topic")), "merged-0")
    step = 0
    while True:
        step += 1
        least = links.join(labels.select(F.col("topic").alias("b"), "merged"), "b").groupBy(F.col("a").alias("topic")).agg(F.min("merged").alias("seen"))
        nearer = labels.select("topic", F.col("merged").alias("before")).join(least, "topic").withColumn("merged", F.least("before", "seen"))
        jump = labels.select(F.col("topic").alias("merged"), F.col("merged").alias("further"))
        after = written(nearer.join(jump, "merged").select("topic", "before", F.least("merged", "further").alias("merged")), f"merged-{step}")
        release(labels)
        labels = after
        if after.filter("before <> merged").isEmpty():
            release(links)
            return topics.select("topic").join(labels.select("topic", "merged"), "topic", "left").withColumn("merged", F.coalesce("merged", "topic"))
