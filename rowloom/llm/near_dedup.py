"""Near-duplicate texts by SetSketch registers, banded, estimated by likelihood, verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import connected_components
from rowloom.llm.setsketch import SketchSpec, likely_jaccard, sketch
from rowloom.llm.textkit import chunks, lowered, shingle_sets, span_hashes, word_spans
from rowloom.llm.workspace import Workspace

#: An estimate this many standard errors below the threshold is still verified.
SLACK_SIGMAS = 4.5
#: Pivot orders: the bands take turns, so a member of a large group meets several pivots.
PIVOT_ORDERS = 4
#: Members, and set elements together, that one side of a comparison task holds at most.
BLOCK = 512
BLOCK_ITEMS = 1_000_000


def _sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offs in chunks(texts):
        data = lowered(data)
        starts, ends, firsts = word_spans(data, offs)
        yield from shingle_sets(span_hashes(data, starts, ends), firsts, k)


def _set_key(elements: np.ndarray) -> bytes:
    return blake2b(elements.tobytes(), digest_size=16).digest()


def _sketches(batches: Iterator[pa.RecordBatch], k: int, spec: SketchSpec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, regs = [], [], []
        for s in _sets_of(batch["text"], k):
            sizes.append(len(s))
            keys.append(_set_key(s))
            regs.append(sketch(s, spec).astype(">u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())],
            names=["doc_id", "n_shingles", "set_key", "regs"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[pa.RecordBatch]:
    bits = wanted.value
    for batch in batches:
        at = batch["slot"].to_numpy()
        batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
        sets = list(_sets_of(batch["text"], k))
        keys = [_set_key(s) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_key", "items"])


def _unpack(regs, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(regs), dtype=">u2").reshape(-1, m).astype(np.uint16)


def _promising(batches: Iterator[pa.RecordBatch], spec: SketchSpec, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (_unpack(batch[c].to_pylist(), spec.m) for c in ("regs_a", "regs_b"))
        sizes = (batch[c].to_numpy().astype(float) for c in ("size_a", "size_b"))
        j = likely_jaccard((a > b).sum(axis=1), (a < b).sum(axis=1), (a == b).sum(axis=1), *sizes, spec.base)
        yield batch.select(["a", "b"]).filter(pa.array(j >= least))


def _block_links(table: pa.Table, spec: SketchSpec, percent: int, least: float) -> pa.Table:
    """Links between components inside one bucket block: every two members of different
    components whose first common band this is are tested, unless links found here already
    join them. At most one link a member comes out."""
    side, band = table["side"].to_numpy(), table["band"][0].as_py()
    ids, comp, size = (table[c].to_numpy() for c in ("cid", "component_id", "n_shingles"))
    regs = _unpack(table["regs"].to_pylist(), spec.m)
    items = table["items"].combine_chunks()
    offs, flat = items.offsets.to_numpy(), items.values.to_numpy()
    _, comp = np.unique(comp, return_inverse=True)
    parent = list(range(int(comp.max()) + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    found = [np.empty((0, 4), dtype=np.int64)]
    for i in left:
        small, large = np.minimum(size[right], size[i]), np.maximum(size[right], size[i])
        with_i = right[(comp[right] != comp[i]) & (100 * small >= percent * large)]
        equal = regs[with_i] == regs[i]
        same = equal.sum(axis=1)
        # One with so few equal registers never passes the estimate.
        here = (equal.reshape(-1, spec.bands, spec.rows).all(axis=2).argmax(axis=1) == band) & (same >= spec.m * (least - 0.15))
        with_i, same = with_i[here], same[here]
        found.append(np.column_stack([np.full(len(with_i), i), with_i, (regs[with_i] < regs[i]).sum(axis=1), same]))
    i, j, above, same = np.concatenate(found).T
    score = np.empty(len(i))
    for at in range(0, len(i), 20_000):  # bounded temporaries
        part = slice(at, at + 20_000)
        score[part] = likely_jaccard(
            above[part], (spec.m - above - same)[part], same[part], size[i[part]].astype(float), size[j[part]].astype(float), spec.base
        )
    order = np.argsort(-score, kind="stable")
    order = order[score[order] >= least]
    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = root(int(comp[x])), root(int(comp[y]))
        if a == b:
            continue
        both = np.concatenate([flat[offs[x] : offs[x + 1]], flat[offs[y] : offs[y + 1]]])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        if 100 * common >= percent * (len(both) - common):
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[x]), int(ids[y])))
    return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})


def near_dedup(documents: DataFrame, shingle: int = 5, threshold: float = 0.8, spec: SketchSpec | None = None) -> DataFrame:
    """Group near-duplicate documents; one row per document.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text's set holds its distinct
    ``shingle``-word shingles. Two texts link when intersection / union >= threshold on the
    full sets. Result: doc_id, n_shingles, component_id (smallest doc_id reachable by links,
    itself included), kept (doc_id = component_id).

    Steps: texts with equal sets collapse into one class, found by a digest of the set. Each
    class is banded by its registers, and every member of a bucket is tried against the
    bucket's pivot (the least of a hash that differs between bands); linked
    members form components. Buckets whose members still lie in different components are then
    compared block by block, so no pair of bucket fellows that could join two components is
    skipped, yet a large group of copies costs a few candidates a member and no task emits
    all its pairs. Candidates pass the likelihood estimate, then the exact test.

    Null or empty text: set size 0, its own component. Fewer words than a shingle: the whole
    sequence is one; long texts count whole. A similarity equal to the threshold links. Repeated rows of one
    doc_id give one row each with equal values; where such rows have different texts, each has the links of its
    own text under the common doc_id. A null doc_id links with nothing and gets a null component and kept
    false. Extra columns are ignored; an empty table gives an empty result.
    """
    spec = spec or SketchSpec()
    spark = documents.sparkSession
    ws = Workspace(spark, "near-dedup")
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = ws.save(
        source.mapInArrow(partial(_sketches, k=shingle, spec=spec), "doc_id long, n_shingles long, set_key binary, regs binary"),
        "sketches",
    )
    filled = sig.where("n_shingles > 0 and doc_id is not null")
    twins = ws.save(
        filled.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("set_key", "first"),
        "twins",
    )
    # Numbered, since the smallest doc_id tells two classes apart only where no doc_id is repeated.
    classes = ws.save(
        filled.join(twins, "set_key", "left").where("first is null or first = doc_id")
        .select("set_key", F.col("first").isNotNull().alias("twin"), F.col("doc_id").alias("first"), "n_shingles", "regs").dropDuplicates(["set_key"])
        .select(F.monotonically_increasing_id().alias("cid"), "*"),
        "classes",
    )
    width = 2 * spec.rows
    keys = classes.select(
        "cid",
        F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(spec.bands)])).alias("band", "key"),
    )
    buckets = ws.save(
        keys.groupBy("band", "key").agg(F.min_by("cid", F.xxhash64("cid", F.col("band") % PIVOT_ORDERS)).alias("pivot"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"),
        "buckets",
    )
    members = ws.save(keys.join(buckets, ["band", "key"]), "members")
    sets = ws.save(_sets(ws, source, classes.join(members.select("cid").distinct(), "cid").select("cid", "set_key", "first"), shingle), "sets")
    least = threshold - SLACK_SIGMAS * (threshold * (1 - threshold) / spec.m) ** 0.5
    percent = round(threshold * 100)
    first = members.where("cid <> pivot").select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b")).distinct()
    size_ok = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")

    def side(x: str) -> DataFrame:
        return classes.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("regs").alias(f"regs_{x}"))

    tried = ws.save(
        first.join(side("a"), "a").join(side("b"), "b").where(size_ok)
        .mapInArrow(partial(_promising, spec=spec, least=least), "a long, b long"),
        "pairs",
    )
    links = ws.save(_verified(sets, tried, percent), "links")
    comps = ws.save(connected_components(ws, links, "cc1"), "components-1")
    more = _undecided_links(ws, members, comps, classes, sets, spec, percent, least)
    if more is not None:
        comps = ws.save(connected_components(ws, links.unionByName(more), "cc2"), "components-2")
    comps = comps.withColumnRenamed("id", "cid")
    named = classes.select("cid", "set_key", "first", "twin").join(comps, "cid", "left")
    least = named.where("component_id is not null").groupBy("component_id").agg(F.min("first").alias("least"))
    groups = ws.save(
        named.join(least, "component_id", "left").where("twin or least is not null").select("set_key", F.coalesce("least", "first").alias("component")), "groups"
    )
    ws.drop("sets", "members", "buckets", "classes", "pairs", "twins")
    out = sig.select("doc_id", "n_shingles", "set_key").join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def _sets(ws: Workspace, source: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cid, items): the full sets of the classes in wanted(cid, set_key, first).

    Which texts those are goes to the scan as a bitmap of hashed ids (about 16 bits an id,
    128 MB at most), so no text is shuffled; the few others that a bit lets through find no class.
    """
    bits = min(30, max(20, (16 * wanted.count()).bit_length()))

    def slot(column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << bits))

    marks = wanted.select(slot("first").alias("slot")).groupBy(F.expr("slot div 32768").alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits")
    )
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in marks.toLocalIterator():
        bitmap[row["page"] * 4096 : row["page"] * 4096 + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    marked = ws.spark.sparkContext.broadcast(bitmap)
    rows = source.where("doc_id is not null").select("text", slot("doc_id").alias("slot"))
    found = rows.mapInArrow(partial(_full_sets, k=shingle, wanted=marked), "set_key binary, items array<long>").dropDuplicates(["set_key"])
    return found.join(wanted.select("set_key", "cid"), "set_key").select("cid", "items")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    a, b = (sets.select(F.col("cid").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")).cast("long"))
    union = F.size("items_a") + F.size("items_b") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("a", "b")


def _undecided_links(ws, members, comps, classes, sets, spec, percent, least) -> DataFrame | None:
    """Links (a, b) between bucket fellows of different components; None if there are no such fellows."""
    placed = members.join(comps.withColumnRenamed("id", "cid"), "cid", "left").select(
        "band", "key", "cid", F.coalesce("component_id", "cid").alias("component_id")
    )
    mixed = ws.save(
        placed.join(classes.select("cid", "n_shingles"), "cid").groupBy("band", "key").agg(
            F.min("component_id").alias("lo"), F.max("component_id").alias("hi"),
            F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_ITEMS).alias("parts"),
        ).where("lo <> hi").select("band", "key", F.ceil("parts").cast("int").alias("parts")),
        "mixed",
    )
    if not mixed.limit(1).count():
        return None
    rest = (
        placed.join(mixed, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        .join(classes, "cid").join(sets, "cid")
    )
    # Every two blocks of a bucket meet in one task; side: 0 first block, 1 second, 2 both are the same.
    spread = rest.select(
        "*",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("parts") - 1),
                lambda other: F.struct(
                    F.least("part", other).alias("i"), F.greatest("part", other).alias("j"),
                    F.when(other == F.col("part"), 2).when(F.col("part") < other, 0).otherwise(1).alias("side"),
                ),
            )
        ).alias("at"),
    ).select("band", "key", "at.i", "at.j", "at.side", "cid", "component_id", "n_shingles", "regs", "items")

    def compare(table: pa.Table) -> pa.Table:
        return _block_links(table, spec, percent, least)

    return ws.save(spread.groupBy("band", "key", "i", "j").applyInArrow(compare, "a long, b long"), "more-links")
