"""License scans by diagonal voting.

Every text is cut into words; the hashes of its rolling word pairs are joined to the positions
of k-grams that begin with the pair in a fixed set of templates, and the k words are compared. A pair of positions votes for the diagonal
(text position - template position). Votes are counted by diagonal, neighbouring diagonals are
merged (words inserted or lost), and a merged run is a span if its verified votes cover enough of
the template. Templates are a few hundred positions written in this module, so they are broadcast;
the join, its word-for-word check and the first count run in the scan of the texts, and only
votes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import load, nth, words_column

#: Short phrases that count wherever their words stand in a row: (label, phrase).
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Longer passages of the licences' own texts and usual notices: (label, passage).
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
PHRASE_K, PASSAGE_K = 2, 4


def templates() -> list[dict]:
    """One entry for each template: id, label, words, k, whether it is a phrase."""
    rows = []
    for phrase, k, group in ((True, PHRASE_K, PHRASES), (False, PASSAGE_K, PASSAGES)):
        rows += [{"label": label, "words": text.split(), "k": k, "phrase": phrase} for label, text in group]
    return [row | {"template": i, "grams": len(row["words"]) - row["k"] + 1} for i, row in enumerate(rows)]


def license_votes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Verified votes by text, template and diagonal, with one row of template null for each text.

    Columns: row (number of the text in this job), the columns of docs but for the text, n_words,
    template, label, phrase, grams, k, diagonal, hits (template positions, distinct).
    """
    keep = [c for c in docs.columns if c != text_col]
    values = ", ".join(f"({t['template']}, '{t['label']}', {t['phrase']}, {t['grams']}, {t['k']}, '{' '.join(t['words'])}')" for t in templates())
    known = docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(template, label, phrase, grams, k, text)").withColumn("template_words", F.split("text", " "))
    places = known.select("*", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("at")).select("template", "label", "phrase", "grams", "k", "at", F.slice("template_words", F.col("at") + 1, F.col("k")).alias("gram"))
    pair = lambda words, i: F.xxhash64(F.get(words, i), F.get(words, i + 1))
    places = places.withColumn("key", pair("gram", F.lit(0)))
    # The row without template keeps each text in the result: it meets the empty word that stands before each text.
    own = docs.sparkSession.sql("SELECT CAST(NULL AS INT) AS template, CAST(NULL AS STRING) AS label, CAST(NULL AS BOOLEAN) AS phrase, CAST(NULL AS INT) AS grams, 1 AS k, 0 AS at, array('') AS gram, 0L AS key")
    places = own.unionByName(places)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.concat(F.array(F.lit("")), words_column(F.col(f"`{text_col}`"))).alias("words"))
    # Each step below runs in the scan's task, in generated code; the words are referred to, not copied.
    rows = texts.select("row", "kept", "words", F.posexplode_outer("words").alias("pos", "word"))
    rows = rows.withColumn("hash", F.when(F.col("pos") == 0, F.lit(0)).otherwise(pair("words", F.col("pos"))))
    met = rows.join(F.broadcast(places), F.col("hash") == F.col("key"))
    met = met.filter(F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("gram"))
    met = met.select("row", "kept", (F.size("words") - 1).alias("n_words"), "template", "label", "phrase", "grams", "k", (F.col("pos") - 1 - F.col("at")).alias("diagonal"), "at")
    return met.groupBy("row", "template", "diagonal").agg(*[F.first(c).alias(c) for c in ("kept", "n_words", "label", "phrase", "grams", "k")], F.collect_set("at").alias("hits"))


def license_scan(docs: DataFrame, text_col: str = "text", cover: float = 0.6, drift: int = 3) -> DataFrame:
    """One row for each row of docs: its columns but for the text, n_words and what was found.

    n_base: places where a phrase of PHRASES stands word for word; first_word and last_word: the
    smallest and largest start of these (null without any). spans: array of (label, template, start,
    end, score) of the passages of PASSAGES found, score being the share of the passage's k-grams
    that voted; a span takes votes of diagonals up to `drift` apart and needs a share of `cover`.
    base_labels and labels: sorted, distinct, joined by commas. score: 1 for a whole passage, 0.5
    at least for a phrase, 0 for nothing found.

    A null or empty text has no words and finds nothing. Repeated rows stay repeated. Columns that
    clash with the made ones, in any case of letters, are replaced.
    """
    votes = license_votes(docs, text_col)
    by_text = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.withColumn("apart", F.col("diagonal") - F.lag("diagonal").over(by_text))
    # A phrase stands word for word: its diagonals are never merged.
    votes = votes.withColumn("run", F.sum(F.when(~F.col("phrase") & (F.col("apart") <= drift), 0).otherwise(1)).over(by_text))
    places = votes.groupBy("row", "template", "run").agg(
        *[F.first(c).alias(c) for c in ("kept", "n_words", "label", "phrase", "grams", "k")],
        F.min("diagonal").alias("diagonal"), F.max("diagonal").alias("last_diagonal"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
    )
    share = F.size("hits") / F.col("grams")
    span = F.struct("label", "template", (F.col("diagonal") + F.array_min("hits")).alias("start"), (F.col("last_diagonal") + F.array_max("hits") + F.col("k")).alias("end"), F.round(share, 6).alias("score"))
    base, passage = F.col("phrase") & (F.size("hits") == F.col("grams")), ~F.col("phrase") & (share >= cover)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    found = places.groupBy("row").agg(
        F.first("kept").alias("kept"), F.first("n_words").cast("long").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), joined(F.collect_set(F.when(base | passage, F.col("label")))).alias("labels"),
        F.array_sort(F.collect_list(F.when(passage, span))).alias("spans"), F.coalesce(F.max(F.when(passage, F.round(share, 6)).when(base, F.lit(0.5))), F.lit(0.0)).alias("score"),
    )
    made = [c for c in found.columns if c not in ("row", "kept")]
    return found.select(*[F.col(f"kept.`{c}`").alias(c) for c in docs.columns if c != text_col and c.lower() not in made], *made)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql_rows() -> str:
    return ", ".join(f"({t['template']}, '{t['label']}', {str(t['phrase']).lower()}, {t['k']}, {t['grams']}, {t['words']!r})" for t in templates())


ORACLE_SQL = f"""
WITH t(template, label, phrase, k, grams, words) AS (VALUES {_sql_rows()}),
place AS (SELECT template, label, phrase, k, grams, o AS at_, words[o + 1 : o + k] AS gram FROM (SELECT *, unnest(range(grams)) AS o FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
p AS (SELECT r, w, unnest(range(len(w))) AS pos FROM d),
g AS (SELECT r, pos, {PHRASE_K} AS k, w[pos + 1 : pos + {PHRASE_K}] AS gram FROM p UNION ALL SELECT r, pos, {PASSAGE_K}, w[pos + 1 : pos + {PASSAGE_K}] FROM p),
v AS (SELECT r, template, label, phrase, grams, pos - at_ AS diagonal, at_ FROM g JOIN place USING (k, gram)),
o AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal, at_) > 3 THEN 1 ELSE 0 END AS cut FROM v),
q AS (SELECT *, CASE WHEN phrase THEN diagonal ELSE sum(cut) OVER (PARTITION BY r, template ORDER BY diagonal, at_ ROWS UNBOUNDED PRECEDING) END AS run FROM o),
s AS (SELECT r, template, label, phrase, min(diagonal) AS start, count(DISTINCT at_) / max(grams) AS share, count(DISTINCT at_) = max(grams) AS full_match FROM q GROUP BY r, template, label, phrase, run),
f AS (SELECT * FROM s WHERE (phrase AND full_match) OR (NOT phrase AND share >= 0.6)),
a AS (SELECT r, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN phrase THEN 0.5 ELSE round(share, 6) END) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""
