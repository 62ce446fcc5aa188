"""Alert rules over trends, with cool-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import release, written

RULE = "id string, kind string, enabled boolean, query string, min_growth double, min_sources int, sources array<string>, cooldown_ms long"
# The three rules that everyone starts with.
DEFAULT_RULES = [
    ("multi-source", "multi_source", True, None, 2.5, 3, None, 45 * 60_000),
    ("global-breaking", "global_breaking", True, None, 4.0, 4, None, 30 * 60_000),
    ("project-velocity", "project_velocity", False, None, 0.8, None, None, 6 * 3_600_000),
]
COOLDOWN_MS, FORGET_MS = 1_800_000, 86_400_000


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, RULE)


def rules_of_watched(watched: DataFrame) -> DataFrame:
    """A rule for each watched entity (entity)."""
    none = lambda t: F.lit(None).cast(t)
    return watched.select(
        F.concat(F.lit("watch-"), "entity").alias("id"), F.lit("watched_entity").alias("kind"), F.lit(True).alias("enabled"), F.col("entity").alias("query"), F.lit(1.0).alias("min_growth"),
        none("int").alias("min_sources"), none("array<string>").alias("sources"), none("long").alias("cooldown_ms"),
    )


def gates() -> Column:
    """Whether trend t may fire rule r at all: growth, coverage and sources."""
    own = F.transform(F.col("t.sources"), lambda s: s["source"])
    passed = F.col("r.enabled") & (F.col("t.growth") >= F.coalesce("r.min_growth", F.lit(1.0))) & (F.col("t.coverage") >= F.coalesce("r.min_sources", F.lit(1)))
    return passed & (F.col("r.sources").isNull() | (F.size("r.sources") == 0) | F.arrays_overlap(own, F.col("r.sources")))


#: A needle's grams have so many characters; shorter needles are grams themselves.
GRAM = 3


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct runs of characters of the given sizes; letters are cut once, so a text costs its length."""
    letters = F.split(text, "")

    def of(n: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(letters))
        return F.filter(F.transform(at, lambda i: F.array_join(F.slice(letters, i, n), "")), lambda g: F.length(g) == n)

    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(F.transform(sizes, of)))).otherwise(F.array().cast("array<string>"))


def needles_in(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Distinct (needle, key) where a text (key, text) contains a needle (needle); empty needles are in none.

    Of each needle the gram that fewest texts have is its key in an index; texts meet needles by their grams, and
    what meets is compared as a whole. Neither texts nor needles are broadcast, and a gram that many
    texts have is met only by needles that have none that is rarer.
    """
    grams = needles.filter("length(needle) > 0").select("needle").distinct().withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    wanted = written(grams.select("needle", F.explode(_grams(F.col("needle"), F.array("size"))).alias("gram")), "needle-grams")
    sizes = wanted.agg(F.array_sort(F.collect_set(F.length("gram"))).alias("sizes")).first().sizes  # at most GRAM numbers
    if not sizes:
        return texts.select(F.lit("").alias("needle"), "key").limit(0)
    numbered = written(texts.filter("text IS NOT NULL").select("key", "text", F.monotonically_increasing_id().alias("row")), "texts")
    own = numbered.select("row", F.explode(_grams(F.col("text"), F.array(*map(F.lit, sizes)))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    own = written(own, "text-grams")
    counts = own.groupBy("gram").agg(F.count("*").alias("n"))
    # A needle with a gram that no text has is in none; its least count is then zero.
    rarest = wanted.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("g")).filter("g.n > 0").select("needle", "g.gram")
    met = own.join(rarest, "gram").select("row", "needle").join(numbered, "row").filter(F.contains("text", F.col("needle")))
    found = written(met.select("needle", "key").distinct(), "needle-hits")
    release(wanted, numbered, own)
    return found


def _needles(rules: DataFrame) -> DataFrame:
    return rules.filter("enabled AND kind = 'keyword' AND query <> ''").withColumn("needle", F.lower(F.trim("query")))


def text_hits(rules: DataFrame, posts: DataFrame) -> DataFrame:
    """(rule_id, topic) where a post of the topic has the query of an enabled keyword rule in its title, body or tags."""
    columns = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in ("title", "body") if c in posts.columns]
    columns += [F.coalesce(F.array_join("tags", "\n"), F.lit(""))] if "tags" in posts.columns else []
    hits = needles_in(posts.select(F.col("topic").alias("key"), F.concat_ws("\n", *columns).alias("text")), _needles(rules))
    return _needles(rules).select(F.col("id").alias("rule_id"), "needle").join(hits.withColumnRenamed("key", "topic"), "needle").select("rule_id", "topic").distinct()


def trend_hits(rules: DataFrame, trends: DataFrame) -> DataFrame:
    """(rule_id, topic) where the title, a keyword or an entity of a trend has the query of an enabled keyword rule."""
    parts = F.explode(F.concat(F.array(F.lower("title")), "keywords", "entities"))
    hits = needles_in(trends.select(F.col("topic").alias("key"), parts.alias("text")), _needles(rules))
    named = _needles(rules).select(F.col("id").alias("rule_id"), "needle")
    return named.join(hits.withColumnRenamed("key", "topic"), "needle").select("rule_id", "topic").distinct()


def _by_numbers(rules: DataFrame, trends: DataFrame) -> DataFrame:
    """(r, t) of rules that look at a trend's numbers alone. Rules of equal conditions are judged once, and meet only trends that their kind fires for."""
    known = ("multi_source", "global_breaking", "topic_surge", "project_velocity")
    kind = F.when(F.col("kind").isin(*known), F.col("kind")).otherwise("other")
    conditions = ["kind_", "enabled", "min_growth", "min_sources", "sources"]
    keyed = rules.withColumn("kind_", kind).withColumn("same", F.xxhash64(F.to_json(F.struct(*conditions))))
    judged = keyed.select(*conditions, "same").dropDuplicates(["same", *conditions])
    hot = F.col("state").isin("breaking", "emerging")
    fires = F.array_compact(F.array(F.lit("multi_source"), F.lit("other"), F.when(hot, "global_breaking"), F.when(F.col("state") != "quiet", "topic_surge"), F.when(F.col("volume") >= 5, "project_velocity")))
    able = trends.withColumn("kind_", F.explode(fires)).alias("t").join(judged.alias("r"), (F.col("t.kind_") == F.col("r.kind_")) & gates() & ((F.col("r.kind_") != "multi_source") | (F.col("t.coverage") >= F.coalesce("r.min_sources", F.lit(3)))))
    able = able.select(F.struct("t.*").alias("t"), F.struct(*[f"r.{c}" for c in ("same", *conditions)]).alias("c"))
    equal = F.col("c.same") == F.col("r.same")
    for c in conditions:
        equal = equal & F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}"))
    return able.join(keyed.alias("r"), equal).select(F.struct(*[f"r.{c}" for c in rules.columns]).alias("r"), "t")


def evaluate_rules(rules: DataFrame, trends: DataFrame, now_ms: int, fired: DataFrame | None = None, posts: DataFrame | None = None) -> DataFrame:
    """Events of the rules that fire now. fired: (rule_id, topic, at_ms) of what fired before. posts: texts for keyword rules.

    Rules that watch an entity meet trends by that entity, keyword rules by the grams of their query, and the
    others, judged once for equal conditions, by what their kind fires for; rules may be as many as trends. A
    trend without a title has its topic for one; without keywords or entities it has none.
    """
    none = F.array().cast("array<string>")
    missing = {"title": F.col("topic"), "keywords": none, "entities": none}
    trends = trends.withColumns({c: v for c, v in missing.items() if c not in trends.columns}).withColumns({c: F.coalesce(c, none) for c in ("keywords", "entities") if c in trends.columns})
    exact = rules.filter("kind = 'watched_entity'").withColumn("needle", F.lower(F.trim("query")))
    by_entity = trends.withColumn("entity_", F.explode(F.array_distinct("entities")))
    watched = by_entity.alias("t").join(exact.alias("r"), (F.col("t.entity_") == F.col("r.needle")) & gates())
    hits = trend_hits(rules, trends)
    hits = hits.union(text_hits(rules, posts)).distinct() if posts is not None else hits
    words = hits.alias("h").join(rules.filter("kind = 'keyword'").alias("r"), F.col("h.rule_id") == F.col("r.id")).join(trends.alias("t"), F.col("h.topic") == F.col("t.topic")).filter(gates())
    blank = "kind = 'keyword' AND query <> '' AND trim(query) = ''"  # such a query is in every text
    numbers = _by_numbers(rules.filter(f"kind IS NULL OR kind NOT IN ('watched_entity', 'keyword') OR {blank}"), trends)
    key = F.concat_ws("::", "r.id", "t.topic")
    made = [
        F.concat(F.lit("alert:"), key, F.lit(f":{now_ms}")).alias("id"), F.col("r.id").alias("rule_id"), F.col("r.kind").alias("kind"), F.col("t.topic").alias("topic"), F.col("t.title").alias("title"), F.col("t.reason").alias("reason"),
        F.lit(now_ms).alias("created_ms"), F.lit(False).alias("read"), F.struct("t.score", "t.velocity", "t.growth", "t.coverage", "t.volume", "t.sources").alias("snapshot"), F.coalesce("r.cooldown_ms", F.lit(COOLDOWN_MS)).alias("cooldown_ms"),
    ]
    events = watched.select(*made).union(words.select(*made)).union(numbers.select(*made))
    if fired is not None:
        last = fired.groupBy("rule_id", "topic").agg(F.max("at_ms").alias("at_ms"))
        events = events.join(last, ["rule_id", "topic"], "left").filter(F.col("at_ms").isNull() | (F.lit(now_ms) - F.col("at_ms") >= F.col("cooldown_ms"))).drop("at_ms")
    return events.drop("cooldown_ms")


def alert_log(stored: DataFrame, events: DataFrame, read_ids: DataFrame | None = None, limit: int | None = 100) -> DataFrame:
    """The log with new events, newest first; read_ids (id) are marked as read. An event that is stored stays as it is."""
    out = stored.unionByName(events.join(stored.select("id"), "id", "left_anti"))
    if read_ids is not None:
        out = out.join(read_ids.select("id").distinct().withColumn("now_read", F.lit(True)), "id", "left").withColumn("read", F.col("read") | F.coalesce("now_read", F.lit(False))).drop("now_read")
    out = out.orderBy(F.desc("created_ms"), "id")
    return out.limit(limit) if limit is not None else out


def fired_after(fired: DataFrame, events: DataFrame, now_ms: int, forget_ms: int = FORGET_MS) -> DataFrame:
    """The cool-down table after an evaluation; what is older than a day is forgotten."""
    both = fired.select("rule_id", "topic", "at_ms").union(events.select("rule_id", "topic", F.col("created_ms")))
    return both.groupBy("rule_id", "topic").agg(F.max("at_ms").alias("at_ms")).filter(F.lit(now_ms) - F.col("at_ms") <= forget_ms)
