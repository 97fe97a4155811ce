"""Natural joins on all shared fields."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.frame import POS, TableFrame, field
from rowloom.functions.aggregates import in_order
from rowloom.functions.natural import natural_key

#: A table of at most so many bytes is dealt out before a join; a larger one comes in parts of its own.
DEAL_MOST = 256 << 20
#: It is dealt out where its bytes times the other table's are this many at least, and the other's are OTHER_LEAST.
DEAL_PAIRS, OTHER_LEAST = 1 << 36, 16 << 10
#: Tasks that a table is dealt to at least.
DEAL_PARTS = 64
#: Key types with room for a null beside them in a long.
_NARROW = (T.ByteType, T.ShortType, T.IntegerType)


def _bytes(df: DataFrame) -> int:
    """Spark's estimate, that of a join being the product of its sides."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(df: DataFrame, size: int, other: int) -> DataFrame:
    """A small table can be one task's whatever a join makes of it, so rows that may meet many partners are
    dealt out evenly first."""
    if size > DEAL_MOST or other < OTHER_LEAST or size * other < DEAL_PAIRS:
        return df
    return df.repartition(max(DEAL_PARTS, 4 * df.sparkSession.sparkContext.defaultParallelism))


def _equal(a: TableFrame, b: TableFrame, f: str):
    """Plain equality, null to null; narrow integers as one long each, which Spark's hash tables hold by itself."""
    x, y = field(f"a.{f}"), field(f"b.{f}")
    if isinstance(a.dtype(f), _NARROW) and isinstance(b.dtype(f), _NARROW):
        return F.coalesce(x.cast("long"), F.lit(1 << 40)) == F.coalesce(y.cast("long"), F.lit(1 << 40))
    return x.eqNullSafe(y)


def natjoin(a: TableFrame, b: TableFrame, left: bool = False, right: bool = False, missing=None, later: int = 0) -> TableFrame:
    """Join on every shared field, by plain equality (null equals null); ``left`` and ``right`` keep rows
    without a partner, whose other fields get ``missing``. Without shared fields: every pair of rows.
    ``later`` is the size in bytes of tables that the result is joined with.

    Spark picks broadcast or sort-merge by size, and splits skewed keys at run time. The side whose rows
    it streams, the larger one unless the other's rows are kept, is dealt out evenly if it is small.
    """
    common = [f for f in a.fields if f in b.fields]
    fields = [*a.fields, *[f for f in b.fields if f not in a.fields]]
    x = a.df.select(F.col(POS).alias("__pa"), F.lit(True).alias("__ha"), *[field(f).alias(f"a.{f}") for f in a.fields])
    y = b.df.select(F.col(POS).alias("__pb"), F.lit(True).alias("__hb"), *[field(f).alias(f"b.{f}") for f in b.fields])
    if not (left and right):
        size_a, size_b = _bytes(a.df), _bytes(b.df)
        if left or not right and size_a >= size_b:
            x = _dealt(x, size_a, max(size_b, later))
        else:
            y = _dealt(y, size_b, max(size_a, later))
    if common:
        on = reduce(lambda p, q: p & q, [_equal(a, b, f) for f in common])
        how = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}[(left, right)]
        both = x.join(y, on, how)
    else:
        both = x.crossJoin(y)

    def cell(f: str):
        if f in common:
            return F.when(F.col("__ha"), field(f"a.{f}")).otherwise(field(f"b.{f}")).alias(f)
        side, here = ("a", "__ha") if f in a.fields else ("b", "__hb")
        own = field(f"{side}.{f}")
        if missing is None:
            return own.alias(f)
        dtype = (a if side == "a" else b).dtype(f)
        return F.when(F.col(here), own).otherwise(F.lit(missing).cast(dtype)).alias(f)

    pos = F.struct(F.col("__pa").alias("a"), F.col("__pb").alias("b")).alias(POS)
    return TableFrame(both.select(pos, *[cell(f) for f in fields]), tuple(fields))


def join(tables: Sequence[TableFrame], left: bool = False, right: bool = False, missing=None) -> TableFrame:
    """Fold from the left; a ``missing`` value alone means a full outer join."""
    if missing is not None and not (left or right):
        left = right = True
    sizes = [_bytes(t.df) for t in tables[2:]]
    out = tables[0]
    for i, t in enumerate(tables[1:]):
        out = natjoin(out, t, left, right, missing, max(sizes[i:], default=0))
    return out


def natjoin_outer(a: TableFrame, b: TableFrame, left: bool = True, right: bool = True, missing=None) -> TableFrame:
    """A natural join that keeps the rows of both sides unless told otherwise."""
    return natjoin(a, b, left, right, missing)


def merge_sorted(tables: Sequence[TableFrame], *keys: str) -> DataFrame:
    """One row for each combination of keys that any table has, in natural order of the keys:
    the keys, and rows1, rows2, ..., each table's rows with them, in order, as an array (empty for none).

    Keys are equal as they are, null to null. Tables are grouped apart and meet in a full join; the rows of
    a combination are gathered.
    """
    out = None
    for i, t in enumerate(tables):
        others = [field(f) for f in t.fields if f not in keys]
        rest = F.struct(*others) if others else F.struct(F.lit(True).alias("found"))
        part = t.df.groupBy(*[field(k).alias(f"k{j}") for j, k in enumerate(keys)]).agg(in_order(rest).alias(f"rows{i + 1}"))
        if out is None:
            out = part
            continue
        part = part.select(*[F.col(f"k{j}").alias(f"o{j}") for j in range(len(keys))], f"rows{i + 1}")
        on = reduce(lambda p, q: p & q, [F.col(f"k{j}").eqNullSafe(F.col(f"o{j}")) for j in range(len(keys))])
        mine = F.col("rows1").isNotNull() if i == 1 else reduce(lambda p, q: p | q, [F.col(f"rows{n + 1}").isNotNull() for n in range(i)])
        both = out.join(part, on, "full")
        out = both.select(*[F.when(mine, F.col(f"k{j}")).otherwise(F.col(f"o{j}")).alias(f"k{j}") for j in range(len(keys))], *[f"rows{n + 1}" for n in range(i + 1)])
    filled = [F.coalesce(f"rows{n + 1}", F.array()).alias(f"rows{n + 1}") for n in range(len(tables))]
    types = [tables[0].dtype(k) for k in keys]
    order = [natural_key(F.col(f"k{j}"), t).asc_nulls_first() for j, t in enumerate(types)]
    return out.orderBy(*order).select(*[F.col(f"k{j}").alias(k) for j, k in enumerate(keys)], *filled)
