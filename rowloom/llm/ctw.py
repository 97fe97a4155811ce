"""Language-model scores: context-tree weighting over bytes, and a word-unigram base score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.textkit import chunks, lowered, span_hashes, word_spans
from rowloom.llm.workspace import Workspace

_U = np.uint64

#: Bytes of context.
DEPTH = 5
#: Byte grams that are broadcast at most (12 bytes each): those that make up one position in
#: HEAVY_GRAMS or more. The probabilities of all others, as precise, reach their texts by a join.
HEAVY_GRAMS = 1 << 22
#: Distinct grams, about, whose part of the tree one task fits.
BUCKET_GRAMS = 250_000
#: Words that are broadcast at most: those that make up one token in HEAVY_WORDS or more. The
#: counts of all other words reach their texts by a join.
HEAVY_WORDS = 1 << 22
#: Counts that a task holds before it hands them on.
HELD = 2_000_000

_END_WORD = np.array([0x1B873593CC9E2D51], dtype=_U)


def byte_grams(data: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``depth`` bytes before it, packed (the byte itself lowest), and the
    first gram of each text. A text ends with one zero byte and is preceded by zero bytes."""
    n = len(offs) - 1
    flat = np.zeros(len(data) + n, dtype=np.uint8)
    ends = offs[1:] + np.arange(n)
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    flat[inside] = data
    firsts = offs[:-1] + np.arange(n)
    out = flat.astype(_U)
    for j in range(1, depth + 1):
        back = np.zeros(len(flat), dtype=_U)
        back[j:] = flat[:-j]
        for i in range(j):  # nothing of the text before
            at = firsts + i
            back[at[at < np.concatenate([firsts[1:], [len(flat)]])]] = 0
        out |= back << _U(8 * j)
    return out, np.concatenate([firsts, [len(flat)]])


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each text's first word index."""
    starts, ends, firsts = word_spans(data, offs)
    return span_hashes(data, starts, ends), firsts


class _Counter:
    """Counts of 64-bit keys, merged now and then; handed on when there are many."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        codes, found = pd.factorize(keys)
        self.parts.append((found, np.bincount(codes, minlength=len(found))))
        self.size += len(found)
        if self.size > HELD and len(self.parts) > 1:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
        codes, found = pd.factorize(np.concatenate([k for k, _ in self.parts]))
        count = np.bincount(codes, weights=np.concatenate([c for _, c in self.parts]), minlength=len(found)).astype(np.int64)
        self.parts, self.size = [(found, count)], len(found)
        return found, count


def _counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, m): kind 0 training words, kind 1 grams; n counts training texts, m all."""
    words, grams, others = _Counter(), _Counter(), _Counter()

    def handed(counter: _Counter) -> Iterator[pa.RecordBatch]:
        keys, count = counter.merge()
        for at in range(0, len(keys), 200_000):
            k, m = keys[at : at + 200_000], count[at : at + 200_000]
            n = np.zeros_like(m) if counter is others else m
            kind = np.full(len(k), int(counter is not words))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(k.view(np.int64)), pa.array(n), pa.array(m)], names=["kind", "key", "n", "m"])
        counter.parts, counter.size = [], 0

    for batch in batches:
        for held in (False, True):
            for at, end, data, offs in chunks(batch.filter(pc.equal(batch["held_out"], held))["text"]):
                data = lowered(data)
                (others if held else grams).add(byte_grams(data, offs, depth)[0])
                if not held:
                    words.add(np.concatenate([_tokens(data, offs)[0], np.repeat(_END_WORD, end - at)]))
        for counter in (words, grams, others):
            if counter.size > HELD:
                yield from handed(counter)
    for counter in (words, grams, others):
        yield from handed(counter)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series after a shift by 8; x > 0."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8.0
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _levels(keys: np.ndarray, counts: np.ndarray, top: int, low: int, below: list | None = None) -> tuple[dict, list]:
    """The nodes of depths ``top`` to ``low``, from the counts of (top + 1)-byte grams.

    Each of the 8 bits of a byte has its own context tree. A node's estimate is
    Krichevsky-Trofimov's on its zeros and ones; its weighted probability is the mean of that
    and the product over its children (one further byte of context). Nodes at ``top`` are
    leaves unless ``below`` has, per bit, the ids of such nodes and the logs of those products.
    Result: by depth, per bit (ids, probability of a one by own counts, weight of that
    estimate, probability of a zero); and per bit (ids, log weighted probability) of depth
    ``low``. Both probabilities are kept, each to its own precision: neither can become 0.
    """
    levels = {}
    for d in range(top, low - 1, -1):
        short, at = np.unique(keys & _U((1 << 8 * (d + 1)) - 1), return_inverse=True)
        n = np.bincount(at, weights=counts, minlength=len(short))
        levels[d], here = [], []
        for b in range(8):
            node = short >> _U(8 - b)
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.empty(0, dtype=int)
            ids = node[first]
            ones = np.add.reduceat(n * ((short >> _U(7 - b)) & _U(1)), first) if len(first) else np.empty(0)
            zeros = (np.add.reduceat(n, first) if len(first) else np.empty(0)) - ones
            own = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)
            if below is None:
                weighted, weight = own, np.ones_like(own)
            else:
                child, child_w = below[b]
                parent = np.searchsorted(ids, child & _U((1 << (8 * d + b)) - 1))
                product = np.bincount(parent, weights=child_w, minlength=len(ids))
                weighted = np.logaddexp(own, product) - np.log(2.0)
                weight = np.exp(own - np.log(2.0) - weighted)
            here.append((ids, weighted))
            total = zeros + ones + 1.0
            levels[d].append((ids, ((ones + 0.5) / total).astype(np.float32), weight.astype(np.float32), ((zeros + 0.5) / total).astype(np.float32)))
        below = here
    return levels, below


def _mixture(levels: dict, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8, n) a and b, such that a + b * p is the probability of each bit of each gram's last
    byte by these depths, where p is what deeper ones say."""
    a, b = np.zeros((8, len(grams))), np.ones((8, len(grams)))
    for d in sorted(levels, reverse=True):
        for bit, (ids, one, weight, zero) in enumerate(levels[d]):
            if len(ids):
                node = (grams & _U((1 << 8 * (d + 1)) - 1)) >> _U(8 - bit)
                at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                own = np.where((grams >> _U(7 - bit)) & _U(1), one[at], zero[at]).astype(np.float64)
                share = np.where(ids[at] == node, weight[at], 0.0).astype(np.float64)
                a[bit] = share * own + (1.0 - share) * a[bit]
                b[bit] *= 1.0 - share
    return a, b


@dataclass
class ContextTree:
    """A whole tree in memory: nodes by depth and bit. Small corpora, and tests of the
    distributed form below, which gives the same probabilities."""

    depth: int
    nodes: dict

    @staticmethod
    def fit(keys: np.ndarray, counts: np.ndarray, depth: int) -> ContextTree:
        """From the counts of all (depth + 1)-byte grams."""
        return ContextTree(depth, _levels(keys.astype(_U), counts.astype(np.float64), depth, 0)[0])

    def evaluate(self, grams: np.ndarray) -> np.ndarray:
        """log2 probability of the last byte of each gram after those before it."""
        a, b = _mixture(self.nodes, grams)
        return np.log2(a + 0.5 * b).sum(axis=0)


_FITTED = "kind int, bit int, key long, m long, value double, told binary"


def _parts(told: np.ndarray) -> pa.Array:
    """Rows of four-byte numbers as binary cells."""
    told = np.ascontiguousarray(told, dtype="<f4")
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * told.shape[1]), len(told), [None, pa.py_buffer(told.tobytes())]).cast(pa.binary())


def _unpacked(told: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(told.to_pylist()), dtype="<f4").reshape(-1, width).T.astype(np.float64)


def _fit_bucket(table: pa.Table, top: int, low: int, deepest: bool) -> pa.Table:
    """The depths ``top`` to ``low`` of one bucket's contexts of ``low`` bytes, from rows of kind
    1, grams of top + 1 bytes, and, unless ``deepest``, of kind 0, sums that the depth below told.

    Result: kind 0, a bit and a node one depth higher, with the sum of its children's log
    weighted probabilities here; kind 1, a gram, m, and what these depths say of its 8 bits (a
    and b of :func:`_mixture`; where they are the deepest, the probability).
    """
    is_gram = table["kind"].to_numpy() == 1
    grams, sums = table.filter(pa.array(is_gram)), table.filter(pa.array(~is_gram))
    keys, n = grams["key"].to_numpy().view(_U), grams["n"].to_numpy()
    below = None
    if not deepest:
        bit, node, value = sums["bit"].to_numpy(), sums["key"].to_numpy().view(_U), sums["value"].to_numpy()
        below = [(node[bit == b], value[bit == b]) for b in range(8)]
    levels, here = _levels(keys[n > 0], n[n > 0].astype(np.float64), top, low, below)
    a, b = _mixture(levels, keys)
    told = (a + 0.5 * b).T if deepest else np.concatenate([a, b]).T
    bits, ids, values = [], [], []
    for bit, (node, weighted) in enumerate(here):
        parent, at = np.unique(node & _U((1 << (8 * (low - 1) + bit)) - 1), return_inverse=True)
        bits.append(np.full(len(parent), bit, dtype=np.int32))
        ids.append(parent)
        values.append(np.bincount(at, weights=weighted, minlength=len(parent)).astype(np.float64))
    bits, ids, values = np.concatenate(bits), np.concatenate(ids), np.concatenate(values)
    return pa.table({
        "kind": pa.array(np.repeat([0, 1], [len(ids), len(keys)]), pa.int32()), "bit": pa.concat_arrays([pa.array(bits), pa.nulls(len(keys), pa.int32())]),
        "key": pa.array(np.concatenate([ids, keys]).view(np.int64)),
        "m": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), grams["m"].combine_chunks()]),
        "value": pa.concat_arrays([pa.array(values, pa.float64()), pa.nulls(len(keys), pa.float64())]),
        "told": pa.concat_arrays([pa.nulls(len(ids), pa.binary()), _parts(told)]),
    })


def _fitting(top: int, low: int, deepest: bool) -> Callable[[pa.Table], pa.Table]:
    def fit(table: pa.Table) -> pa.Table:
        return _fit_bucket(table, top, low, deepest)

    return fit


def _known(batches: Iterator[pa.RecordBatch], upper: dict, joined: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch["key"].to_numpy().view(_U)
        p = _unpacked(batch["told"], 8)
        for name in joined:
            told = _unpacked(batch[name], 16)
            p = told[:8] + told[8:] * p
        a, b = _mixture(upper, keys)
        value = np.log10(a + b * p).sum(axis=0)
        yield pa.RecordBatch.from_arrays([batch["key"], batch["m"], pa.array(value.astype(np.float32))], names=["key", "m", "value"])


def _stages(depth: int, cut: int) -> list[tuple[int, int]]:
    """(top, low) of the runs of depths from ``depth`` up to ``cut``, two each."""
    out = []
    while depth >= cut:
        out.append((depth, max(cut, depth - 1)))
        depth -= 2
    return out


def gram_values(ws: Workspace, grams: DataFrame, depth: int) -> DataFrame:
    """(key, m, value): the log10 probability that the tree gives each gram in grams(key, n, m).

    The tree is fitted two depths at a time, the deepest first. A run of depths deals its contexts to
    buckets by all their bytes but the farthest of the deeper depth, so that a context has at
    most 65,536 grams, however hot it is, and a task some BUCKET_GRAMS; the next run gets sums of what its
    nodes' children said. Of the two uppermost depths only sums are gathered: at most 65,280 nodes
    and 65,536 grams. What the runs say of a gram meets by joins on its nearest bytes.
    """
    cut = min(2, depth)
    stages = _stages(depth, cut)
    sums, told = None, []
    for top, low in stages:
        here = grams if top == depth else ws.save(
            grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (top + 1)) - 1).alias("key")).agg(F.sum("n").alias("n"), F.lit(None).cast("long").alias("m")), f"grams-{top}"
        )
        buckets = max(64, -(-here.count() // BUCKET_GRAMS))
        near = (1 << 8 * low) - 1
        rows = here.select(
            F.lit(1).alias("kind"), F.lit(None).cast("int").alias("bit"), "key", "n", "m", F.lit(None).cast("double").alias("value"),
            F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(near)), F.lit(buckets)).alias("bucket"),
        )
        if sums is not None:
            context = F.expr("shiftrightunsigned(key, bit)").bitwiseAND(near)
            none = F.lit(None).cast("long")
            rows = rows.unionByName(sums.select(F.lit(0).alias("kind"), "bit", "key", none.alias("n"), none.alias("m"), "value", F.pmod(F.xxhash64(context), F.lit(buckets)).alias("bucket")))
        fitted = ws.save(rows.groupBy("bucket").applyInArrow(_fitting(top, low, top == depth), _FITTED), f"tree-{top}")
        sums = fitted.where("kind = 0").groupBy("bit", "key").agg(F.sum("value").alias("value"))
        told.append(fitted.where("kind = 1"))
    top_sums = sums.orderBy("bit", "key").toArrow()
    short = grams.where("n > 0").groupBy(F.col("key").bitwiseAND((1 << 8 * cut) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    bit, key, value = top_sums["bit"].to_numpy(), top_sums["key"].to_numpy().view(_U), top_sums["value"].to_numpy()
    below = [(key[bit == b], value[bit == b]) for b in range(8)]
    upper, _ = _levels(short["key"].to_numpy().view(_U), short["n"].to_numpy().astype(np.float64), cut - 1, 0, below)
    every, joined = told[0].select("key", "m", "told"), []
    for (top, _), part in zip(stages[1:], told[1:], strict=True):
        joined.append(f"told{top}")
        suffix = F.col("key").bitwiseAND((1 << 8 * (top + 1)) - 1)
        every = every.withColumn("suffix", suffix).join(part.select(F.col("key").alias("suffix"), F.col("told").alias(joined[-1])), "suffix").drop("suffix")
    known = ws.save(every.mapInArrow(partial(_known, upper=upper, joined=joined), "key long, m long, value float"), "known")
    ws.drop(*[f"tree-{top}" for top, _ in stages], *[f"grams-{top}" for top, _ in stages[1:]])
    return known


_SCORED = "row long, kind int, key long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long"


def _looked_up(keys: np.ndarray, owner: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]):
    """Sums of the values and numbers of the keys found, by owner; and the others as
    (owner, key, count)."""
    codes, found = pd.factorize(keys)
    heavy, values = table
    hit, value = np.zeros(len(found), dtype=bool), np.zeros(len(found))
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
        hit = heavy[at] == found
        value = np.where(hit, values[at], 0.0)
    told = hit[codes]
    rest, count = np.unique(owner[~told] * len(found) + codes[~told], return_counts=True)
    sums = np.bincount(owner, weights=value[codes], minlength=n), np.bincount(owner, weights=told, minlength=n).astype(np.int64)
    return *sums, (rest // max(1, len(found)), found[rest % max(1, len(found))], count)


def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row a text with what the broadcast tables say of it, and a row for each word (kind 0)
    and gram (kind 1) of it that they do not hold."""
    depth, heavy_words, heavy_grams = shared.value
    schema = pa.schema([pa.field(name, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[kind]) for name, kind in (x.split() for x in _SCORED.split(", "))])
    for batch in batches:
        for at, end, data, offs in chunks(batch["text"]):
            n, data = end - at, lowered(data)
            doc = batch.slice(at, n)
            grams, starts = byte_grams(data, offs, depth)
            score, _, light_grams = _looked_up(grams, np.repeat(np.arange(n), np.diff(starts)), n, heavy_grams)
            token, firsts = _tokens(data, offs)
            owner = np.concatenate([np.repeat(np.arange(n), np.diff(firsts)), np.arange(n)])
            base, known, light_words = _looked_up(np.concatenate([token, np.repeat(_END_WORD, n)]), owner, n, heavy_words)
            each = {
                "row": doc["row"], "doc_id": doc["doc_id"], "held_out": doc["held_out"], "n_tokens": np.bincount(owner, minlength=n),
                "n_known": known, "base": base, "score": score, "n_bytes": np.diff(offs),
            }
            yield pa.RecordBatch.from_arrays([pa.array(each[f.name], f.type) if f.name in each else pa.nulls(n, f.type) for f in schema], schema=schema)
            for kind, (whose, key, count) in enumerate((light_words, light_grams)):
                m = len(key)
                each = {"row": doc["row"].take(pa.array(whose)), "kind": np.full(m, kind), "key": key.view(np.int64), "n": count}
                yield pa.RecordBatch.from_arrays([pa.array(each[f.name], f.type) if f.name in each else pa.nulls(m, f.type) for f in schema], schema=schema)


def _heavy(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    keys = table["key"].to_numpy().view(_U)
    order = np.argsort(keys)
    return keys[order], table["value"].to_numpy()[order].astype(kind)


def lm_scores(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Score every whole text, learning from those whose id's crc32 modulo 7 is not 2.

    Model: context-tree weighting over the bytes of the text (A-Z lower-cased) and one closing
    zero byte, each byte split into 8 binary decisions, contexts of up to ``depth`` bytes (1 to 7),
    the same at every size; counts come from all training texts, then the tree is fixed. Result: doc_id, held_out,
    n_tokens (words ``[^\\x20\\x09-\\x0D]+`` and one end), n_known (tokens met in training),
    train_tokens, base_score (sum of log10((c + 1) / (N + V + 1))), score (log10 probability of
    the text by the model), bits_per_byte (code length per byte, the closing one included).

    Null or empty texts have only their end; texts of any length are scored whole. A null doc_id counts as training. Repeated rows count as
    often as they stand and give equal rows. Without training texts every bit has probability one half. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "lm")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")
    )
    counts = ws.save(
        rows.select("text", "held_out").mapInArrow(partial(_counts, depth=depth), "kind int, key long, n long, m long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")),
        "counts",
    )
    words, grams = counts.where("kind = 0"), counts.where("kind = 1").select("key", "n", "m")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    places = grams.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    known = gram_values(ws, grams, depth)
    logs = words.select("key", "n", F.log10(F.col("n") + 1.0).alias("value"))
    least_word, least_gram = max(2, -(-facts["tokens"] // HEAVY_WORDS)), max(1, -(-places // HEAVY_GRAMS))
    heavy_words = _heavy(logs.where(F.col("n") >= least_word).select("key", "value").toArrow(), np.float64)
    heavy_grams = _heavy(known.where(F.col("m") >= least_gram).select("key", "value").toArrow(), np.float32)
    shared = spark.sparkContext.broadcast((depth, heavy_words, heavy_grams))
    scored = ws.save(rows.mapInArrow(partial(_scores, shared=shared), _SCORED), "scored")
    rare = logs.where(F.col("n") < least_word).select(F.lit(0).alias("kind"), "key", "value").unionByName(
        known.where(F.col("m") < least_gram).select(F.lit(1).alias("kind"), "key", "value")
    )
    part = F.col("n") * F.col("value").cast("double")
    light = (
        scored.where("kind is not null").select("row", "kind", "key", "n").join(rare, ["kind", "key"])
        .groupBy("row").agg(
            F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n_light"),
            F.sum(F.when(F.col("kind") == 0, part)).alias("base_light"), F.sum(F.when(F.col("kind") == 1, part)).alias("score_light"),
        )
    )
    unit = float(np.log10(facts["tokens"] + facts["distinct"] + 1))
    score = F.col("score") + F.coalesce("score_light", F.lit(0.0))
    return scored.where("kind is null").drop("kind", "key", "n").join(light, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("n_light", F.lit(0))).alias("n_known"),
        F.lit(facts["tokens"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_light", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), score.alias("score"),
        (-score / F.lit(float(np.log10(2.0))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
