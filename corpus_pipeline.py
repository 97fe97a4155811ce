"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next.

Every stage but the last returns the columns of its input, whatever they are named, and
decides each row by its own text: rows with a null doc_id or a repeated one are decided like
all others. Null texts count as empty, long texts are read whole, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.classifiers import without_poor, without_toxic
from rowloom.llm.decontaminate import decontaminate
from rowloom.llm.mixing import mix_rows
from rowloom.llm.near_dedup import near_dedup
from rowloom.llm.workspace import DOC, ROW, Workspace, texts
from rowloom.workspace import mark, release


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts toxic go (a score equal to the threshold is toxic).
    Empty texts get the score of a text without features; equal rows stay or go together."""
    return without_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not select go (a probability equal to the
    threshold is selected). Empty texts are graded by their size alone; equal rows stay or go together."""
    return without_poor(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8) stays: that
    with the smallest doc_id, one with a null id only where the group has no other. Texts without
    words are no near-duplicates; of those that repeat a doc_id one stays."""
    rows = Workspace(spark, "near-copies").numbered(docs, "rows")
    found = near_dedup(texts(rows).select(F.col(ROW).alias("doc_id"), "text")).withColumnRenamed("doc_id", ROW)
    named = found.join(texts(rows).select(ROW, "doc_id"), ROW)
    blank = F.col("n_shingles") == 0
    group = [F.when(blank & F.col("doc_id").isNotNull(), None).otherwise(F.col("component_id")).alias("group"), F.when(blank, F.col("doc_id")).alias("repeated")]
    first = named.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)).alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(f"{DOC}.*")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, items with a null or repeated item_id included; empty texts hold none."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the raked weights; ``copies`` says how often one is in the mix (a
    column of that name is replaced). Null source or lang form a category of their own; texts without
    tokens are not drawn; rows of one doc_id, and those without any, draw the same number."""
    return mix_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
]

#: Classifiers and banded sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    ws = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = mark()
        docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        release(before)  # the stage's own tables
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
