"""Mixing to target weights: iterative proportional fitting of token weights, then sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.native_text import unit_hash
from rowloom.llm.workspace import Workspace

# Topics told by a pattern in the text, first match; the rest is "general".
TOPICS = (("legal", r"[Ll]icen[cs]|[Cc]opyright"), ("contact", r"[a-z0-9]@[a-z0-9]|https?://"), ("tabular", r" \| "))

#: Target shares of a marginal are the observed token shares to this power, unless given.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
SWEEPS = 8
#: Expected tokens of the sample, as a share of all.
BUDGET = 0.5


def topic_of(text) -> F.Column:
    text = F.coalesce(text, F.lit(""))
    out = F.lit("general")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def described(documents: DataFrame) -> list:
    """Expressions of the three marginals and the token count; null source or lang is 'unknown'."""
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        topic_of(F.col("text").cast("string")).alias("topic"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    ]


#: Cells that are raked in one task at most (a few dozen bytes each); beyond, each sum is an exchange.
TASK_CELLS = 100_000


def fitted_cells(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """The cells(source, lang, topic, tokens) with their raked weight w.

    Cell weights start as token sums and are raked: in each sweep, for each marginal in turn,
    every weight is multiplied by target / current sum of its category. Targets (category ->
    share) are brought to sum 1 over the categories present; a category without a given
    target gets 0, one without tokens is left alone.
    """
    dims = ["source", "lang", "topic"]
    cells = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in dims:
        over = Window.partitionBy(d)
        if targets and d in targets:
            given = F.create_map(*[x for k, v in sorted(targets[d].items()) for x in (F.lit(k), F.lit(float(v)))])
            goal = F.coalesce(F.element_at(given, F.col(d)), F.lit(0.0))
        else:
            goal = F.pow(F.sum("tokens").over(over).cast("double"), F.lit(POWERS[d]))
        cells = cells.withColumn(f"goal_{d}", goal)
    for _ in range(sweeps):
        for d in dims:
            now = F.sum("w").over(Window.partitionBy(d))
            cells = cells.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"goal_{d}") / now).otherwise(F.lit(0.0)))
    return cells.select(*dims, "tokens", "w")


def residuals(rows: DataFrame, cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(marginal, category, target, reached): the share of tokens that each category of the given
    targets should have, and has once its cells are drawn; a few rows, whatever the corpus.

    Targets are brought to sum 1 over the categories that have tokens. Raking meets them all in the
    limit where any mixture does; this tells how near the fixed number of sweeps came.
    """
    drawn = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0").join(cells, ["source", "lang", "topic"])
    parts = []
    for d, shares in targets.items():
        given = F.create_map(*[x for k, v in sorted(shares.items()) for x in (F.lit(k), F.lit(float(v)))])
        sums = drawn.groupBy(F.col(d).alias("category")).agg(F.sum(F.col("tokens") * F.col("expected_copies")).alias("got"))
        over = Window.partitionBy()  # a row a category
        goal = F.coalesce(F.element_at(given, F.col("category")), F.lit(0.0))
        parts.append(sums.select(F.lit(d).alias("marginal"), "category", (goal / F.sum(goal).over(over)).alias("target"), (F.col("got") / F.sum("got").over(over)).alias("reached")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def mixture(ws: Workspace, rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, expected_copies): expected copies of each document of a cell, as a
    written table. The sum of tokens times copies is ``budget`` times all tokens, in the raked proportions."""
    sums = ws.save(rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sums")
    if sums.count() <= TASK_CELLS:
        sums = sums.coalesce(1)  # so no sum needs an exchange
    cells = ws.save(fitted_cells(sums, targets), "cells")
    total = cells.agg(F.sum("tokens").alias("all_tokens"), F.sum("w").alias("all_w")).first()
    scale = budget * (total["all_tokens"] or 0) / (total["all_w"] or 1.0)
    return cells.select("source", "lang", "topic", (F.col("w") * F.lit(scale) / F.col("tokens")).alias("expected_copies"))


def sampled(rows: DataFrame, cells: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds expected_copies and copies: its whole part, and one more with the probability of the rest."""
    e = F.coalesce(F.col("expected_copies"), F.lit(0.0))
    both = rows.join(cells, ["source", "lang", "topic"], "left").withColumn("expected_copies", e)
    extra = unit_hash(seed, F.col("doc_id")) < F.col("expected_copies") - F.floor("expected_copies")
    return both.withColumn("copies", (F.floor("expected_copies") + extra.cast("int")).cast("long"))


def mix(documents: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """Calibrate and sample: doc_id, source, lang, topic, n_tokens, expected_copies, copies per document row.

    A document is in the sample ``copies`` times; expected token sums follow the raked weights. Null or
    empty texts have no tokens and, in a cell without any, 0 copies. Null source or lang form
    the category 'unknown'. Equal rows (and equal doc_ids) draw the same number. Extra
    columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(documents.sparkSession, "mixing")
    rows = ws.save(documents.select(F.col("doc_id").cast("long").alias("doc_id"), *described(documents)), "described")
    out = sampled(rows, mixture(ws, rows, targets=targets, budget=budget), seed)
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("expected_copies", 9).alias("expected_copies"), "copies")


def mix_rows(documents: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: str = "mix") -> DataFrame:
    """The sampled documents with all their columns, and copies (1 or more).

    An input column named copies is replaced. Null texts have no tokens and, like all of a cell
    without any, are not drawn; null source or lang form the category 'unknown'. Rows that
    repeat a doc_id, and rows without one, draw the same number. An empty table gives an empty result.
    """
    ws = Workspace(documents.sparkSession, "mixing")
    cells = mixture(ws, documents.select(*described(documents)), targets, budget)
    named = documents.select(F.struct("*").alias("doc"), F.struct(*described(documents)[:3]).alias("cell"))
    both = named.join(cells.select(F.struct("source", "lang", "topic").alias("cell"), F.col("expected_copies").alias("e")), "cell")
    extra = unit_hash(seed, F.col("doc.doc_id")) < F.col("e") - F.floor("e")
    copies = (F.floor("e") + extra.cast("int")).cast("long")
    kept = [F.col("doc").getField(c).alias(c) for c in documents.columns if c != "copies"]
    return both.select(*kept, copies.alias("copies")).where("copies > 0")


def sql(sweeps: int = SWEEPS, budget: float = BUDGET, seed: str = "mix", documents: str = "documents") -> str:
    """The same computation as one SQL statement."""
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    goals = ", ".join(f"pow(CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE), {p}) AS goal_{d}" for d, p in POWERS.items())
    steps = [d for _ in range(sweeps) for d in POWERS]
    raked = reduce(lambda s, x: s + [
        f"r{x[0]} AS (SELECT source, lang, topic, tokens, goal_source, goal_lang, goal_topic, w * goal_{x[1]} / sum(w) OVER (PARTITION BY {x[1]}) AS w FROM r{x[0] - 1})"
    ], enumerate(steps, 1), [])
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
         CASE {topic} ELSE 'general' END AS topic,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM {documents}
), c AS (
  SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0
), r0 AS (
  SELECT source, lang, topic, tokens, {goals}, CAST(tokens AS DOUBLE) AS w FROM c
), {", ".join(raked)},
e AS (
  SELECT source, lang, topic, w * ({budget} * sum(tokens) OVER () / sum(w) OVER ()) / tokens AS e FROM r{len(steps)}
), j AS (
  SELECT d.*, coalesce(e.e, 0.0) AS e,
         CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM d LEFT JOIN e USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, round(e, 9) AS expected_copies,
       CAST(floor(e) AS BIGINT) + CASE WHEN u < e - floor(e) THEN 1 ELSE 0 END AS copies
FROM j
"""
