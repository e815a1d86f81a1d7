"""License texts in documents: diagonal voting of word k-grams against templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, pick

GRAM = 3

#: Phrases that decide a label wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Passages of well-known licenses; a span that keeps enough of one gets its label.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
        " with the license you may obtain a copy of the license at"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met redistributions of source code must retain the above copyright notice"
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation"
    ),
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced",
}

#: Largest step between diagonals of one span (words put in or left out), and least share of a template's
#: grams that a span must keep.
SLACK, COVERAGE = 4, 0.6


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    slack: int = SLACK,
    coverage: float = COVERAGE,
) -> DataFrame:
    """A row per row of `docs`: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    All rolling 3-grams of a text's words are joined to the template positions that have the same gram
    (by hash, then word by word). Hits vote for their diagonal (word position minus template position);
    diagonals at most `slack` apart in one template are merged to a span. A span is verified: it counts if
    the distinct template positions it hits make up `coverage` of the template's grams, in a stretch of words not longer than
    the template's by 1 / `coverage`, and if no overlapping span of another template keeps a larger share (then more
    grams, then the later label). A phrase counts at a diagonal that
    holds all its grams, that is, where its words stand consecutively; those places are n_base.
    labels are those of places and spans; score is the best share of grams kept, 1 for a phrase, 0 for none;
    spans lists (label, first word, last word, share) of the templates found.

    The templates are a constant of the program, so broadcasting them is bounded; hits are the only rows that
    are shuffled, by document. A phrase or template needs at least three words.

    Null text counts as empty: no words, no labels. Rows that repeat id and text are counted as one and
    returned as often as they came; a null id is an id like any other. An empty table gives an empty
    result. Further columns are ignored.
    """
    spark = docs.sparkSession
    known = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, t in templates.items()]
    grams = []
    for number, (text, label, base) in enumerate(known):
        words = text.split()
        size = len(words) - GRAM + 1
        grams += [(number, label, base, size, i, *words[i : i + GRAM]) for i in range(size)]
    templates_df = spark.createDataFrame(
        grams, "template int, label string, base boolean, grams int, at int, t0 string, t1 string, t2 string"
    ).withColumn("code", F.xxhash64("t0", "t1", "t2"))

    # The empty word at the end holds the row of a document without hits.
    words = pick(docs, id=id_col, text=text_col).select(
        "id", F.xxhash64("text").alias("version"), F.concat(words_of(F.col("text")), F.array(F.lit(""))).alias("w")
    )
    size = F.size("w")
    rolled = words.select(
        "id",
        "version",
        F.posexplode(
            F.arrays_zip(F.col("w").alias("w0"), F.slice("w", 2, size).alias("w1"), F.slice("w", 3, size).alias("w2"))
        ).alias("place", "g"),
    ).select("id", "version", "place", "g.*")
    hits = (
        rolled.withColumn("code", F.when(F.col("w2").isNotNull(), F.xxhash64("w0", "w1", "w2")))
        .join(F.broadcast(templates_df), "code", "left")
        .filter("(w0 = t0 and w1 = t1 and w2 = t2) or w0 = ''")
    )
    key = ["id", "version"]
    diagonals = hits.groupBy(*key, "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"),
        F.collect_set("at").alias("found"),
        F.min("place").alias("first"),
        F.max("place").alias("last"),
        *[F.first(c).alias(c) for c in ("label", "base", "grams")],
    )
    whole = Window.partitionBy(*key)
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    spans = (
        # The empty word has no template; its votes are the number of equal rows, its place the number of words.
        diagonals.withColumn("copies", F.max(F.when(F.col("template").isNull(), F.col("votes"))).over(whole))
        .withColumn("n_words", F.max(F.when(F.col("template").isNull(), F.col("last"))).over(whole))
        .withColumn(
            "new",
            (F.coalesce("base", F.lit(True)) | (F.col("diagonal") - F.lag("diagonal").over(along) > slack)).cast("int"),
        )
        .withColumn("span", F.sum(F.coalesce("new", F.lit(1))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("one", F.struct(F.size("found").alias("hits"), (-F.col("first")).alias("first"), "last"))
    )
    # Each template position counts once, on however many diagonals of the span it was hit.
    span_key = [*key, "template", "span", "label", "base", "grams", "copies", "n_words"]
    merged = (
        spans.withColumn("at", F.explode_outer("found"))
        .groupBy(*span_key, "at")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("one").alias("one"))
        .groupBy(*span_key)
        .agg(F.count("at").alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("one").alias("one"))
    )
    # A span longer than a template with as many words put in as may be lacking isn't one passage: its best diagonal counts.
    compact = (F.col("last") - F.col("first") + GRAM) * coverage <= F.col("grams") + (GRAM - 1)
    merged = merged.select(
        *span_key,
        F.when(compact, F.col("hits") / F.col("grams")).otherwise(F.col("one.hits") / F.col("grams")).alias("share"),
        F.when(compact, F.col("first")).otherwise(-F.col("one.first")).alias("first"),
        (F.when(compact, F.col("last")).otherwise(F.col("one.last")) + GRAM - 1).alias("last"),
    )
    verified = merged.filter(F.coalesce("base", F.lit(True)) | (F.col("share") >= coverage))
    # Of spans that overlap the best wins. None is longer than `reach`, so rivals start near, and there they are few.
    reach = max([len(t.split()) for t in templates.values()], default=0) / coverage
    near = Window.partitionBy(*key).orderBy("first").rangeBetween(-int(reach) - 1, int(reach) + 1)
    passage = F.when(~F.coalesce("base", F.lit(True)), F.struct("share", "grams", "label", "first", "last"))
    rivals = F.filter(
        F.collect_list(passage).over(near),
        lambda o: (o["label"] != F.col("label")) & (o["first"] <= F.col("last")) & (o["last"] >= F.col("first"))
        & (F.struct(o["share"], o["grams"], o["label"]) > F.struct("share", "grams", "label")),
    )
    verified = verified.withColumn("beaten", (F.size(rivals) > 0) & ~F.coalesce("base", F.lit(True)))
    base = F.col("base") & (F.col("share") >= 1)
    span = ~F.col("base") & ~F.col("beaten")
    out = verified.groupBy(*key).agg(
        F.first("copies").alias("copies"),
        F.first("n_words").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | span, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | span, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(
            F.collect_list(F.when(span, F.struct("first", "last", "label", "share")))
        ).alias("spans"),
    )
    return (
        out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .drop("copies", "version")
        .withColumnRenamed("id", id_col)
    )


def oracle(phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> str:
    """The same result in DuckDB's SQL."""
    known = [(p, label, True) for p, label in phrases.items()] + [(t, label, False) for label, t in templates.items()]
    values = []
    for number, (text, label, base) in enumerate(known):
        words = text.split()
        size = len(words) - GRAM + 1
        for i in range(size):
            values.append(f"({number}, '{label}', {base}, {size}, {i}, " + ", ".join(f"'{w}'" for w in words[i : i + GRAM]) + ")")
    return f"""
WITH t(template, label, base, grams, pos, t0, t1, t2) AS (VALUES {", ".join(values)}),
d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), r AS (SELECT doc_id, w, unnest(range(0, len(w) - {GRAM - 1})) AS p FROM d),
h AS (
  SELECT doc_id, template, label, base, grams, p - pos AS diagonal, p
  FROM r JOIN t ON w[p + 1] = t0 AND w[p + 2] = t1 AND w[p + 3] = t2
), v AS (
  SELECT doc_id, template, label, base, grams, diagonal, count(*) AS votes, min(p) AS first, max(p) AS last
  FROM h GROUP BY ALL
), n AS (
  SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER a > {SLACK} THEN 1 ELSE 0 END AS new
  FROM v WINDOW a AS (PARTITION BY doc_id, template ORDER BY diagonal)
), s AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM n
), q AS (
  SELECT doc_id, template, label, base, grams, span, count(DISTINCT p - s.diagonal) AS hits, min(p) AS first, max(p) AS last
  FROM s JOIN h USING (doc_id, template, label, base, grams, diagonal) GROUP BY ALL
), b AS (
  SELECT doc_id, template, span, max(struct_pack(hits := votes, first := -first, last := last)) AS one FROM s GROUP BY ALL
), m AS (
  SELECT doc_id, label, base, grams, (last - first + {GRAM}) * {COVERAGE} <= grams + {GRAM - 1} AS compact,
         CASE WHEN compact THEN hits / grams ELSE one.hits / grams END AS share,
         CASE WHEN compact THEN first ELSE -one.first END AS first, CASE WHEN compact THEN last ELSE one.last END + {GRAM - 1} AS last
  FROM q JOIN b USING (doc_id, template, span)
), g AS (SELECT * FROM m WHERE share >= CASE WHEN base THEN 1 ELSE {COVERAGE} END),
k AS (
  SELECT * FROM g WHERE base OR NOT EXISTS (
    SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND NOT o.base AND o.label <> g.label AND o.first <= g.last AND o.last >= g.first
      AND (o.share, o.grams, o.label) > (g.share, g.grams, g.label))
),
o AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word,
         max(first) FILTER (base) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN o USING (doc_id)
"""
