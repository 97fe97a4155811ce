"""License scans by diagonal voting of word k-grams, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.native_text import ascii_words, grams, within

# Exact phrases and their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# The opening words of public licence notices and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
)

#: Words so common that a gram of them alone casts no vote.
COMMON = frozenset("a an and any are by can for in is it of or that the this to under with you".split())
#: Words in a voting gram.
K = 2
#: Diagonals this close, their votes within REACH words, are one occurrence with words put in or left out.
SLIP = 3
REACH = 8
#: Share of a notice's votes that an occurrence must have.
LEAST_SHARE = 0.85


def template_rows(phrases=BASE_PHRASES, notices=NOTICES) -> list[tuple[str, int, str, bool, int, int]]:
    """(gram, template, label, base, at, votes) of every voting gram."""
    rows = []
    for n, (text, label) in enumerate([*phrases, *notices]):
        w, base = text.split(), n < len(phrases)
        found = [(" ".join(w[i : i + K]), i) for i in range(len(w) - K + 1) if base or not COMMON.issuperset(w[i : i + K])]
        rows += [(g, n, label, base, i, len(found)) for g, i in found]
    return rows


def license_scan(documents: DataFrame, phrases=BASE_PHRASES, notices=NOTICES) -> DataFrame:
    """Find licence phrases and notices in every whole text.

    All rolling word 2-grams join the templates' grams on their hash (and are compared as
    words). A hit votes for the diagonal word position - template position. A base phrase
    stands wherever a diagonal has all its votes. For notices, neighbouring diagonals merge,
    so that a few inserted or missing words do no harm, and an occurrence counts when its
    span has LEAST_SHARE of the notice's votes.

    Result, one row per document row: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (smallest and largest start, else null), base_labels, labels
    (distinct, sorted, joined by commas; empty if none), score (best share of votes, 0 to 1),
    n_spans (occurrences of notices). Null or empty texts have no words. Repeated rows give
    equal rows, null ids stay null, extra columns are ignored, an empty table gives none.
    """
    spark = documents.sparkSession
    array = ascii_words(F.col("text").cast("string"))
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), array.alias("w"))
    # A last element that no gram equals carries the number of words, so that one pass serves all.
    rolled = docs.select("row", "doc_id", F.posexplode(F.concat(grams(F.col("w"), K), F.array(F.concat(F.lit("#"), F.size("w"))))).alias("pos", "gram"))
    total = F.col("gram").startswith("#")
    rolled = rolled.withColumn("h", F.when(total, F.lit(0)).otherwise(F.xxhash64("gram")))
    templates = [*template_rows(phrases, notices), ("#", None, None, None, None, None)]
    known = spark.createDataFrame(templates, "same string, template int, label string, base boolean, at int, votes int")
    known = known.withColumn("h", F.when(F.col("template").isNull(), F.lit(0)).otherwise(F.xxhash64("same")))
    hits = rolled.join(within(len(templates), known), "h").where((F.col("gram") == F.col("same")) | total & F.col("template").isNull())
    diagonals = hits.groupBy("row", "doc_id", "template", "label", "base", "votes", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("got"), F.min("pos").alias("low"), F.max("pos").alias("high"),
        F.max(F.when(F.col("template").isNull(), F.substring("gram", 2, 20).cast("long"))).alias("n_words"),
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    before = F.lag("diagonal").over(along)
    apart = (F.col("diagonal") - before > SLIP) | (F.greatest(F.col("low") - F.lag("high").over(along), F.lag("low").over(along) - F.col("high")) > REACH)
    runs = diagonals.withColumn("new", F.coalesce(F.when(F.col("base"), F.lit(True)).otherwise(apart), F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(along)
    )
    spans = runs.groupBy("row", "doc_id", "template", "label", "base", "votes", "run").agg(
        F.sum("got").alias("got"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("start"), F.max("n_words").alias("n_words")
    )
    share = F.when(F.col("template").isNotNull(), F.least(F.lit(1.0), F.col("got") / F.col("votes")))
    place = F.col("base") & (F.col("got") == F.col("votes"))
    notice = ~F.col("base") & (share >= LEAST_SHARE) & (F.col("high") - F.col("low") < 2 * F.col("votes") + REACH)
    spans = spans.select("*", F.coalesce(place, F.lit(False)).alias("place"), F.coalesce(notice, F.lit(False)).alias("notice"), share.alias("share"))

    def joined(flag) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col("label")))), ",")

    return (
        spans.groupBy("row", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.count_if("place").alias("n_base"),
            F.min(F.when(F.col("place"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("place"), F.col("start"))).cast("long").alias("last_word"),
            joined(F.col("place")).alias("base_labels"), joined(F.col("place") | F.col("notice")).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.count_if("notice").alias("n_spans"),
        ).drop("row")
    )


def sql(documents: str = "documents") -> str:
    """The same computation as one SQL statement."""
    rows = ", ".join(f"('{g}', {t}, '{label}', {base}, {at}, {votes})" for g, t, label, base, at, votes in template_rows())
    plain = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
WITH t(gram, template, label, base, place_at, votes) AS (VALUES {rows}
), d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array({plain}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM {documents}
), g AS (
  SELECT row, unnest(range(0, len(w) - 1)) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d WHERE len(w) > 1
), v AS (
  SELECT row, template, label, base, votes, pos - place_at AS diagonal, count(*) AS got, min(pos) AS low, max(pos) AS high FROM g JOIN t USING (gram) GROUP BY ALL
), n AS (
  SELECT *, CASE WHEN base OR before IS NULL OR diagonal - before > {SLIP} OR greatest(low - before_high, before_low - high) > {REACH} THEN 1 ELSE 0 END AS new
  FROM (SELECT *, lag(diagonal) OVER p AS before, lag(high) OVER p AS before_high, lag(low) OVER p AS before_low FROM v WINDOW p AS (PARTITION BY row, template ORDER BY diagonal))
), r AS (
  SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal) AS run FROM n
), s AS (
  SELECT row, label, base, votes, sum(got) AS got, min(low) AS low, max(high) AS high, min(diagonal) AS start FROM r GROUP BY row, template, label, base, votes, run
), o AS (
  SELECT row, label, start, least(1.0::DOUBLE, got::DOUBLE / votes) AS share, base AND got = votes AS place,
         NOT base AND least(1.0::DOUBLE, got::DOUBLE / votes) >= {LEAST_SHARE} AND high - low < 2 * votes + {REACH} AS notice FROM s
), a AS (
  SELECT row, count(*) FILTER (place) AS n_base, min(start) FILTER (place) AS first_word, max(start) FILTER (place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (place OR notice) AS labels,
         max(share) AS score, count(*) FILTER (notice) AS n_spans FROM o GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN a USING (row)
"""
