"""Near-duplicate embeddings: cross-polytope hashes after fast Hadamard rotations, multiprobe, verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.components import connected_components
from rowloom.llm.textkit import stream
from rowloom.llm.workspace import Workspace

_U = np.uint64

#: Tables where a bucket joins two hashes; :func:`effort` has those for more hashes.
TABLES = 6
#: Buckets of a table in which a vector stands, its own and the likeliest others, for two hashes.
PROBES = 3
#: Bytes of vectors, about, that one side of a comparison holds at most.
BLOCK_BYTES = 4 << 20
#: Pairs compared at a time, and components of the vectors of such pairs gathered at a time, about.
PAIRS = 1 << 20
GATHERED = 1 << 22
#: Hashes a bucket joins are as many as keep the expected number of unrelated fellows near this.
FELLOWS = 64


def effort(hashes: int, tables: int = TABLES, probes: int = PROBES) -> tuple[int, int]:
    """(tables, probes) for so many hashes a bucket: each further hash makes it less likely that a
    near pair shares a bucket of a table, which so many more tables and probes make good."""
    return tables * (hashes - 1), probes + hashes - 2


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, in log2(width) passes; width a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation: three rounds of random signs and a Hadamard transform."""
    for turn in range(3):
        signs = np.where(stream(x.shape[1], 1000 * seed + turn) >> _U(63), 1.0, -1.0)
        x = hadamard(x * signs)
    return x


def bucket_ids(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, tables * probes) bucket ids of unit vectors.

    A hash is the nearest signed axis after a rotation; a table's bucket joins several, as the
    digits of one number below the table's own, so that different buckets never share an id.
    The further buckets replace one hash by its second nearest axis where that loses least.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rows = np.arange(len(x))
    out = np.empty((len(x), tables * probes), dtype=_U)
    for t in range(tables):
        best, second, loss = [], [], []
        for h in range(hashes):
            y = rotated(x, t * 16 + h + 1)
            size = np.abs(y)
            order = np.argpartition(-size, 1, axis=1)[:, :2]
            flip = size[rows, order[:, 0]] < size[rows, order[:, 1]]
            order[flip] = order[flip][:, ::-1]
            a, b = order[:, 0], order[:, 1]
            best.append(2 * a + (y[rows, a] < 0))
            second.append(2 * b + (y[rows, b] < 0))
            loss.append(size[rows, a] - size[rows, b])
        best, second, loss = (np.stack(v, axis=1) for v in (best, second, loss))
        choice = np.argsort(loss, axis=1, kind="stable")
        for p in range(probes):
            codes = best.copy()
            if 0 < p <= hashes:
                at = choice[:, p - 1]
                codes[rows, at] = second[rows, at]
            key = np.full(len(x), t, dtype=_U)
            for h in range(hashes):
                key = key * _U(2 * width) + codes[:, h].astype(_U)
            out[:, t * probes + p] = key
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a digest of each vector that can link; equal vectors have equal digests."""
    for batch in batches:
        lists = batch["embedding"]
        kind = lists.type.value_type.to_pandas_dtype()
        size = np.diff(lists.offsets.to_numpy()) * np.array(lists.is_valid())
        flat = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) + kind(0)  # null components become NaN, -0 becomes 0
        keys: list = [None] * len(lists)
        for i, (at, n) in enumerate(zip(lists.offsets.to_numpy()[:-1].tolist(), size.tolist(), strict=True)):
            x = flat[at : at + n]
            if n and np.isfinite(x).all() and x.any():
                keys[i] = blake2b(x.tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(keys, pa.binary()), lists], names=["vec_id", "digest", "vector"])


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch["size"].to_numpy()
        order = np.argsort(size, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if not len(at):
                continue
            part = batch.take(pa.array(at))
            ids = bucket_ids(_unit(_matrix(part["vector"])), tables, hashes, probes).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * ids.shape[1], pa.int32()), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, "buckets"])


def _first_shared(a: np.ndarray, b: np.ndarray, here: np.ndarray, probes: int) -> np.ndarray:
    """Whether ``here`` is the first bucket, in the order of tables, that rows a and b share.

    Only buckets of one table can be equal, and near vectors mostly share one of the first
    table, so most pairs are decided by a few comparisons.
    """
    alive = np.ones(len(here), dtype=bool)
    rest = np.arange(len(here))
    for t in range(0, a.shape[1], probes):
        x, y = a[rest, t : t + probes], b[rest, t : t + probes]
        least = np.full(len(rest), np.iinfo(np.int64).max)
        for p in range(probes):
            least = np.minimum(least, np.where((y == x[:, p, None]).any(axis=1), x[:, p], np.iinfo(np.int64).max))
        shared = least != np.iinfo(np.int64).max
        alive[rest[shared]] = least[shared] == here[rest[shared]]
        rest = rest[~shared]
        if not len(rest):
            break
    return alive


class _Block:
    """The rows of whole buckets (or pairs of bucket parts), and the links found among them."""

    def __init__(self, table: pa.Table, probes: int, threshold: float):
        self.cid, self.copies, self.bucket = (table[c].to_numpy() for c in ("cid", "copies", "bucket"))
        self.x, self.sets = (_matrix(table[c].combine_chunks()) for c in ("vector", "buckets"))
        self.x = _unit(self.x)
        self.probes, self.threshold = probes, threshold
        self.count = np.zeros(len(self.cid), dtype=np.int64)
        self.parent = np.arange(len(self.cid))
        self.links: list[tuple[int, int]] = []

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _flat(self) -> np.ndarray:
        """The root of every row."""
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def near(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count pairs of near rows, each in the first bucket that both are in and in no other;
        of the links keep a forest."""
        mine = _first_shared(self.sets[i], self.sets[j], self.bucket[i], self.probes)
        i, j = i[mine], j[mine]
        if not len(i):
            return
        n = len(self.count)
        self.count += np.bincount(i, weights=self.copies[j], minlength=n).astype(np.int64) + np.bincount(j, weights=self.copies[i], minlength=n).astype(np.int64)
        root = self._flat()
        a, b = root[i], root[j]
        _, one = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
        for k in one[a[one] != b[one]].tolist():
            ra, rb = self._root(int(a[k])), self._root(int(b[k]))
            if ra != rb:
                self.parent[max(ra, rb)] = min(ra, rb)
                self.links.append((int(self.cid[i[k]]), int(self.cid[j[k]])))

    def small(self, begin: np.ndarray, size: np.ndarray) -> None:
        """All pairs inside each of these runs of rows, many runs at a time."""
        follow = np.repeat(begin + size, size) - 1  # the last row of a row's run
        row = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        fellows = follow - row
        pairs = max(1, GATHERED // self.x.shape[1])
        for at in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(fellows) // pairs)) + 1):
            n = fellows[at]
            i = np.repeat(row[at], n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = np.einsum("ij,ij->i", self.x[i], self.x[j]) >= self.threshold
            i, j = i[hit], j[hit]
            differ = self.cid[i] != self.cid[j]
            self.near(i[differ], j[differ])

    def large(self, left: np.ndarray, right: np.ndarray, whole: bool) -> None:
        """All pairs of two runs of rows, or of one with itself."""
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            i, j = np.nonzero(self.x[rows] @ self.x[right].T >= self.threshold)
            i, j = rows[i], right[j]
            keep = i < j if whole else self.cid[i] != self.cid[j]
            self.near(i[keep], j[keep])

    def table(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.count)
        found = np.array(self.links, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([self.cid[some], found[:, 0]])),
            pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(found[:, 1])]),
            pa.array(np.concatenate([self.count[some], np.zeros(len(found), dtype=np.int64)])),
        ], names=["a", "b", "n"])


def _compared(table: pa.Table, probes: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of whole groups, in the order of their keys: for each vector how many others it links
    with (b null), and links (a, b) that join those."""
    keys = np.column_stack([table[c].to_numpy() for c in ("size", "bucket", "i", "j")])
    begin = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    size = np.diff(np.r_[begin, len(keys)])
    for at in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(keys[begin, 0])) + 1):  # vectors of one length
        first = int(begin[at[0]])
        block = _Block(table.slice(first, int(size[at].sum())), probes, threshold)
        starts, sizes = begin[at] - first, size[at]
        side = table["side"].to_numpy()[first : first + len(block.cid)]
        little = (sizes < 64) & (side[starts] == 2)
        block.small(starts[little], sizes[little])
        for b, n in zip(starts[~little].tolist(), sizes[~little].tolist(), strict=True):
            rows = np.arange(b, b + n)
            whole = bool(side[b] == 2)
            block.large(rows if whole else rows[side[rows] == 0], rows if whole else rows[side[rows] == 1], whole)
        yield block.table()


def _compare(batches: Iterator[pa.RecordBatch], probes: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their keys; a group may reach over several batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        ends = [batch[c][-1].as_py() for c in ("size", "bucket", "i", "j")]
        last = np.logical_and.reduce([batch[c].to_numpy() == e for c, e in zip(("size", "bucket", "i", "j"), ends, strict=True)])
        open_rows = int(last.sum())
        if open_rows == batch.num_rows:
            continue  # nothing but the group that goes on
        table = pa.Table.from_batches(held)
        yield from _compared(table.slice(0, rows - open_rows), probes, threshold)
        held, rows = [batch.slice(batch.num_rows - open_rows)], open_rows
    if rows:
        yield from _compared(pa.Table.from_batches(held), probes, threshold)


def embedding_dedup(embeddings: DataFrame, threshold: float = 0.95, tables: int = TABLES, probes: int = PROBES, block: int | None = None) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least ``threshold``.

    Result, one row per row: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable by links, itself included), kept (vec_id = component_id).

    Equal vectors collapse into one class with a number of copies. Classes stand in the
    buckets of ``tables`` hash tables, of more (see :func:`effort`) where larger inputs make a
    bucket join more than two hashes, so that recall does not fall with size; all fellows of a
    bucket are compared, those of a large one in parts of ``block`` vectors (by default BLOCK_BYTES of them),
    and what leaves a task is a count for each vector and a forest of links, never the pairs. Pairs that
    share no bucket are missed; see the README for the recall.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
    of different lengths never link. A null vec_id links with nothing and is not kept. Rows that repeat a
    vec_id with an equal vector are copies of each other; with different vectors, each row has the
    links of its own vector, and all carry the same vec_id. A cosine equal to the threshold links. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    ws = Workspace(spark, "embeddings")
    # Components stay as narrow as they come; cosines are computed in double precision.
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    clean = ws.save(rows.mapInArrow(_clean, f"vec_id long, digest binary, vector array<{kind}>"), "vectors")
    good = clean.where("digest is not null and vec_id is not null")
    # Numbered, since two classes may have the same smallest vec_id where a vec_id is repeated.
    classes = ws.save(
        good.groupBy("digest").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        .select(F.monotonically_increasing_id().alias("cid"), "digest", "first", "copies", "vector", F.size("vector").alias("size")),
        "classes",
    )
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("width")).first()
    width = facts["width"] or 2
    axes = 2 << max(1, (width - 1).bit_length())
    hashes = 2
    while facts["n"] > FELLOWS * axes**hashes:
        hashes += 1
    tables, probes = effort(hashes, tables, probes)
    block = block or max(256, BLOCK_BYTES // (width * (4 if kind == "float" else 8) + 8 * tables * probes))
    hashed = ws.save(
        classes.select("cid", "copies", "size", "vector").mapInArrow(
            partial(_hashed, tables=tables, hashes=hashes, probes=probes), f"cid long, copies long, size int, vector array<{kind}>, buckets array<long>"
        ),
        "hashed",
    )
    placed = hashed.select("cid", "size", F.explode(F.array_distinct("buckets")).alias("bucket"))
    full = ws.save(
        placed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "bucket", F.ceil(F.col("n") / block).cast("int").alias("parts")),
        "buckets",
    )
    rest = placed.join(full, ["size", "bucket"]).join(hashed.drop("size"), "cid").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    spread = rest.select("*", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(
            F.least("part", other).alias("i"), F.greatest("part", other).alias("j"),
            F.when(other == F.col("part"), 2).when(F.col("part") < other, 0).otherwise(1).alias("side"),
        ),
    )).alias("at")).select("size", "bucket", "at.i", "at.j", "at.side", "cid", "copies", "vector", "buckets")
    keys = ("size", "bucket", "i", "j")
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys)
    found = ws.save(dealt.mapInArrow(partial(_compare, probes=probes, threshold=threshold), "a long, b long, n long"), "found")
    comps = ws.save(connected_components(ws, found.where("b is not null").select("a", "b"), "cc").withColumnRenamed("id", "cid"), "components")
    degree = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    linked = classes.select("cid", "digest", "first", "copies").join(comps, "cid", "left").withColumn("component", F.coalesce("component_id", "cid"))
    least = linked.where("component_id is not null").groupBy("component").agg(F.min("first").alias("least"))
    known = ws.save(
        linked.join(degree, "cid", "left").join(least, "component", "left").where("copies > 1 or n is not null")
        .select("digest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id")),
        "known",
    )
    out = clean.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
