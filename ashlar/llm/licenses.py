"""License scans by diagonal voting [native: DataFrame functions only].

Every template is a sequence of words.  All rolling k-grams of a document's words
are hashed and joined to the positions of the same k-gram in the templates; a
match at document word i and template word j votes for the diagonal i - j, where
the template would start.  Votes are aggregated by diagonal, neighbouring
diagonals of a template (words inserted or left out) merge into one span, and a
span counts if enough of the template's words stand there.

Every k-gram of every whole text is looked up by the join; words are compared, not
only hashes, so a vote is never one of a hash alone.  Positions of templates are
broadcast if they are no more than POSITIONS, else joined by a shuffle.  What is
shuffled beyond that join is one row for each document and for each vote.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii

#: What separates words (after lower-casing A-Z): all of ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3

#: Phrases whose every place counts, with their labels.
BASE = {
    "the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further templates, found also with a few words changed.
TEMPLATES = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit",
    "released under the mit license": "mit",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "licensed under the bsd license": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

#: A span of a further template counts if this share of its words stands there (under ten words: all).
COVER = 0.9
#: Diagonals of one template that lie this near to each other merge.
GAP = 2


#: Template positions that are broadcast at most (some 100 bytes each).
POSITIONS = 200_000


def known_templates(spark: SparkSession) -> DataFrame:
    """(label, text, base) of BASE and TEMPLATES."""
    rows = [*((label, text, True) for text, label in BASE.items()), *((label, text, False) for text, label in TEMPLATES.items())]
    return spark.createDataFrame(rows, "label string, text string, base boolean")


def _words(text: Column) -> Column:
    """The words of a text; splitting leaves an empty string at either end at most."""
    return F.array_remove(F.split(lower_ascii(text), BREAK), "")


def _gram(at: Column) -> Column:
    """The hash of the K words from place at (from 0) on."""
    return F.xxhash64(*[F.get(F.col("words"), at + k) for k in range(K)])


def template_positions(templates: DataFrame) -> DataFrame:
    """(template, label, base, t_size, t_pos, gram, g_words) for every k-gram of every template; templates of fewer than K words have none."""
    rows = templates.select("label", F.coalesce("base", F.lit(False)).alias("base"), _words(F.col("text")).alias("words")).distinct().filter(F.size("words") >= K)
    rows = rows.withColumn("t_pos", F.explode(F.sequence(F.lit(0), F.size("words") - K)))
    return rows.select(F.xxhash64("label", "base", "words").alias("template"), "label", "base", F.size("words").alias("t_size"), "t_pos", _gram(F.col("t_pos")).alias("gram"), F.slice("words", F.col("t_pos") + 1, K).alias("g_words"))


def conjunction_of(parts) -> Column:
    return reduce(and_, parts)


def votes(docs: DataFrame, id_col: str, text_col: str, templates: DataFrame) -> DataFrame:
    """A row for each document (template null) and one for each k-gram match, keyed by id and the text's SHA-256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        # texts of one id are told apart by this alone, and texts of equal XXH64 are easily made
        F.unhex(F.sha2(text, 256)).alias("digest"),
        _words(text).alias("words"),
    )
    n = F.size("words")
    # place 0 stands for the document itself and meets the one row of the templates' side that has no template
    places = F.sequence(F.lit(0), F.greatest(n - (K - 1), F.lit(0)))
    found = rows.select("id", "digest", n.alias("n_words"), "words", F.explode(places).alias("place"))
    found = found.withColumn("d_gram", F.when(F.col("place") > 0, _gram(F.col("place") - 1)).otherwise(F.lit(0)))
    positions = template_positions(templates)
    few = positions.count() <= POSITIONS
    itself = docs.sparkSession.range(1).select(*[F.lit(0 if f.name == "gram" else None).cast(f.dataType).alias(f.name) for f in positions.schema])
    positions = positions.union(itself)
    joined = found.join(F.broadcast(positions) if few else positions, (F.col("d_gram") == F.col("gram")) & ((F.col("place") == 0) == F.col("template").isNull()))
    real = conjunction_of(F.get(F.col("words"), F.col("place") + (k - 1)) == F.get(F.col("g_words"), F.lit(k)) for k in range(K))
    return joined.filter(F.col("template").isNull() | real).select(
        "id", "digest", "n_words", "template", "label", "base", "t_size", "t_pos",
        F.when(F.col("template").isNotNull(), F.col("place") - 1 - F.col("t_pos")).alias("start"),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans, one row for each row of docs.

    n_base counts every place where a base phrase's words stand consecutively;
    first_word and last_word are the smallest and largest of their starts (from
    0), else null.  labels also holds those of further templates of whose words
    COVER or more stand in one span; score is the largest share found, 0 without.
    spans lists what was found: (label, start, share of the template's words).
    A null or empty text has no words, an empty label string and score 0.
    Repeated rows give equal rows, and different texts of one id rows of their own; other columns are not read.  templates (label,
    text, base) may hold whole licenses; the default is ``known_templates``.  An
    empty table gives an empty result.
    """
    templates = known_templates(docs.sparkSession) if templates is None else templates
    key = ["id", "digest", "n_words"]
    by_diagonal = votes(docs, id_col, text_col, templates).groupBy(*key, "template", "label", "base", "start", "t_size").agg(F.count("*").alias("votes"), F.collect_set("t_pos").alias("at"))
    # neighbouring diagonals of a further template merge
    order = Window.partitionBy(*key, "template").orderBy("start")
    apart = F.when(F.col("base") | (F.col("start") - F.lag("start").over(order) > GAP) | F.lag("start").over(order).isNull(), 1).otherwise(0)
    runs = by_diagonal.withColumn("new", apart).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*key, "template", "label", "base", "t_size", "run").agg(
        F.min("start").alias("start"),
        F.flatten(F.collect_list("at")).alias("at"),
        F.when(F.col("template").isNull(), F.sum("votes")).alias("rows"),
    )
    # repeated rows double every vote: their number is the votes of the rows without a template
    spans = spans.withColumn("copies", F.max("rows").over(Window.partitionBy(*key)))
    # template words that a vote of the span covers
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (K - 1)))))) / F.col("t_size")
    spans = spans.withColumn("share", covered)
    # a base phrase stands on one diagonal, in whole
    good = F.col("template").isNotNull() & (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(COVER))
    base = good & F.col("base")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy(*key).agg(
        F.first("copies").alias("copies"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(good).alias("labels"),
        F.coalesce(F.max(F.when(good, F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good, F.struct("label", "start", "share")))).alias("spans"),
    )
    found = found.withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    return found.select("id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of documents; edge cases as in ``scan``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumnRenamed("id", "doc_id").drop("spans")


_ROWS = ", ".join(f"({i}, '{label}', {str(base).lower()}, string_split('{text}', ' '))" for i, (label, text, base) in enumerate([*((v, k, True) for k, v in BASE.items()), *((v, k, False) for k, v in TEMPLATES.items())]))
OP6_SQL = rf"""
WITH t(template, label, base, words) AS (VALUES {_ROWS}),
tg AS (SELECT template, label, base, len(words) AS t_size, words[j + 1 : j + {K}] AS gram, j FROM (SELECT *, unnest(range(0, len(words) - {K - 1})) AS j FROM t)),
d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS words
  FROM documents
),
dg AS (SELECT doc_id, words[i + 1 : i + {K}] AS gram, i FROM (SELECT doc_id, words, unnest(range(0, len(words) - {K - 1})) AS i FROM d)),
v AS (SELECT doc_id, template, label, base, t_size, i - j AS start, j FROM dg JOIN tg USING (gram)),
diagonals AS (SELECT DISTINCT doc_id, template, label, base, t_size, start FROM v),
marked AS (
  SELECT *, CASE WHEN base OR lag(start) OVER w IS NULL OR start - lag(start) OVER w > {GAP} THEN 1 ELSE 0 END AS fresh
  FROM diagonals WINDOW w AS (PARTITION BY doc_id, template ORDER BY start)
),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM marked),
words AS (SELECT runs.doc_id, runs.template, runs.label, runs.base, runs.t_size, run, runs.start, unnest(range(j, j + {K})) AS word FROM runs JOIN v USING (doc_id, template, start)),
spans AS (SELECT doc_id, label, base, min(start) AS start, count(DISTINCT word)::double / t_size AS share FROM words GROUP BY doc_id, template, label, base, t_size, run),
good AS (SELECT * FROM spans WHERE share >= CASE WHEN base THEN 1.0 ELSE {COVER} END),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM good GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM d LEFT JOIN found USING (doc_id)
"""
