"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.native_text import gram_hashes, grams, within, words
from rowloom.llm.workspace import Workspace

#: Size partitions of test items: (most shingles, rows a band, bands). At containment 0.8 an
#: item is missed with probability (1 - 0.8 ** rows) ** bands, under 1e-5 in each partition.
PARTITIONS = ((8, 1, 8), (64, 2, 14), (None, 3, 20))


def item_shingles(ws: Workspace, benchmark: DataFrame, k: int) -> DataFrame:
    """(item, item_id, gram, h, n, span) of every distinct shingle of each test item.

    item is a number of its own for each different (item_id, words), so that null and repeated
    item_ids keep their texts apart; span is the number of words in a shingle (k, or all words
    of a shorter item), n the item's number of shingles.
    """
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text").cast("string")).alias("w"))
    # Written before use, so that an item keeps its number.
    items = ws.save(named.where(F.size("w") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "numbered-items")
    span = F.least(F.size("w"), F.lit(k))
    found = F.array_distinct(F.when(F.size("w") >= k, grams(F.col("w"), k)).otherwise(F.array(F.array_join("w", " "))))
    rows = items.select("item", "item_id", span.alias("span"), F.size(found).alias("n"), F.explode(found).alias("gram"))
    return ws.save(rows.withColumn("h", F.xxhash64(F.split("gram", " "))), "items")


def item_minima(shingles: DataFrame) -> DataFrame:
    """(h, item, rows, bands, mask): the MinHash minima of every item; bit i of mask is set where
    the shingle has the item's least i-th hash. The size partition sets rows and bands."""
    def by_size(i: int) -> F.Column:
        out = F.lit(PARTITIONS[-1][i])
        for part in reversed(PARTITIONS[:-1]):
            out = F.when(F.col("n") <= part[0], F.lit(part[i])).otherwise(out)
        return out

    sized = shingles.select("item", "h", by_size(1).alias("rows"), by_size(2).alias("bands"))
    registers = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("bands") - 1)).alias("i"))
    least = registers.groupBy("item", "rows", "bands", "i").agg(F.min_by("h", F.xxhash64("h", "i")).alias("h"))
    return least.groupBy("h", "item", "rows", "bands").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))


def candidates(docs: DataFrame, minima: DataFrame, spans: list[int]) -> DataFrame:
    """(key, item) of every document that holds all minima of one band of an item; ``spans``
    are the lengths of the items' shingles.

    docs(key, w) keeps its whole shingle stream, in which the minima are looked up: those of a
    ten-shingle item would vanish among the minima of a long document.
    """
    hashes = F.concat(*[gram_hashes(F.col("w"), n) for n in spans]) if spans else F.array().cast("array<bigint>")
    stream = docs.select("key", F.explode(hashes).alias("h"))
    held = stream.join(minima, "h").groupBy("key", "item", "rows", "bands").agg(F.bit_or("mask").alias("mask"))
    full = F.expr("exists(sequence(0, bands - 1), j -> (shiftrightunsigned(mask, j * rows) & (shiftleft(1L, rows) - 1)) = shiftleft(1L, rows) - 1)")
    return held.where(full).select("key", "item")


def found_items(texts: DataFrame, benchmark: DataFrame, k: int, threshold: float) -> DataFrame:
    """(key, item_id, n_shared, n) for every test item found in the texts(key, text); rows of one key are one text."""
    ws = Workspace(texts.sparkSession, "decontaminate")
    shingles = item_shingles(ws, benchmark, k)
    minima = ws.save(item_minima(shingles), "minima")
    facts = shingles.agg(F.count(F.lit(1)).alias("rows"), F.collect_set("span").alias("spans")).first()
    spans = sorted(facts["spans"])

    def docs(of: DataFrame) -> DataFrame:
        return of.select("key", words(F.col("text")).alias("w"))

    tried = ws.save(candidates(docs(texts), within(minima.count(), minima), spans), "candidates")
    again = docs(texts.join(tried.select("key").distinct(), "key", "left_semi"))
    found = F.concat(*[grams(F.col("w"), n) for n in spans]) if spans else F.array().cast("array<string>")
    stream = again.select("key", F.explode(found).alias("found")).withColumn("h", F.xxhash64(F.split("found", " ")))
    hits = stream.join(within(facts["rows"], shingles), "h").where("found = gram").select("key", "item", "item_id", "n", "h").distinct()
    pairs = hits.join(tried, ["key", "item"], "left_semi").groupBy("key", "item", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    return pairs.where(100 * F.col("n_shared") >= round(100 * threshold) * F.col("n")).drop("item")


def contaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Documents that hold test items: doc_id, item_id, n_shared, n_item, containment.

    An item is found in a document when at least ``threshold`` of the item's distinct k-word
    shingles stand in the document. Words are runs of letters and digits, lower-cased. Items
    are partitioned by their number of shingles, each partition with its own MinHash bands; a
    document is a candidate when it holds all minima of one band of the item. Only candidates
    are read again, and verified by exact containment of all shingles.

    Items with fewer than k words count as one shingle of all their words; items and documents
    without words match nothing. Equal item rows count once; rows that repeat an item_id with
    another text are items of their own, and a null item_id is found like any other (in rows with a
    null item_id). Rows of one doc_id count as one document; null doc_ids are left out, as nothing
    could name them (:func:`decontaminate` decides rows, whatever their id). Containment equal to
    the threshold counts as found. Extra columns are ignored; empty tables give an empty result.
    """
    named = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return found_items(named, benchmark, k, threshold).select(
        F.col("key").alias("doc_id"), "item_id", "n_shared", F.col("n").cast("long").alias("n_item"), F.round(F.col("n_shared") / F.col("n"), 9).alias("containment")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents, all columns, in which no test item is found; each row is decided by its own
    text, whatever its doc_id. The key of a text is its 128-bit digest, so nothing is numbered."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = documents.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"), F.struct("*").alias("doc"))
    found = found_items(keyed.select("key", "text"), benchmark, k, threshold)
    return keyed.drop("text").join(found.select("key").distinct(), "key", "left_anti").select("doc.*")
