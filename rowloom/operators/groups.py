"""Grouping, cross tabulation and categorising."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.frame import POS, TableFrame, field
from rowloom.functions.aggregates import decomposed, folded, in_order, is_user
from rowloom.functions.natural import cell_text, natural_key
from rowloom.operators.rows import ROW, numbered
from rowloom.workspace import written

#: Columns of a cross table, at most: its header is gathered, a cell of Spark's plan each.
CROSS_COLUMNS = 10_000


def _grouped(table: TableFrame, keys: Sequence[str], specs: Sequence[str]) -> DataFrame:
    """One row for each natural key: __k0 .. (the natural keys), __v0 .. (the first row's
    cells), __first (the first row's ordinal) and __a0 .. (the aggregates).

    Rows are first grouped by the cells as they are, with sums and counts that a hash table holds;
    natural keys are made for the distinct cells only, and groups of one natural key are merged.
    User aggregates cannot be merged, so with one of them rows are grouped by natural keys at once.
    """
    types = [table.dtype(k) if k in table.fields else T.StringType() for k in keys]
    cells = [field(k) if k in table.fields else F.lit(None).cast("string") for k in keys]
    steps = [decomposed(table, s) for s in specs]
    parts = [[f"__p{i}_{j}" for j in range(len(a.partial))] for i, a in enumerate(steps)]
    partial = [c.alias(n) for a, names in zip(steps, parts, strict=True) for c, n in zip(a.partial, names, strict=True)]
    results = [a.result([F.col(n) for n in names]).alias(f"__a{i}") for i, (a, names) in enumerate(zip(steps, parts, strict=True))]
    heads = [F.col(f"__k{i}") for i in range(len(keys))]
    firsts = [F.col(f"__v{i}") for i in range(len(keys))]
    df = table.df.select("*", *[c.alias(f"__v{i}") for i, c in enumerate(cells)])
    natural = [natural_key(F.col(f"__v{i}"), t).alias(f"__k{i}") for i, t in enumerate(types)]
    if any(is_user(s) for s in specs):
        least = [F.min_by(f"__v{i}", POS).alias(f"__v{i}") for i in range(len(keys))]
        out = df.select("*", *natural).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min(POS).alias("__first"), *least, *partial)
        return out.select(*heads, *firsts, "__first", *results)
    raw = df.groupBy(*[f"__v{i}" for i in range(len(keys))]).agg(F.min(POS).alias("__first"), *partial)
    if not any(isinstance(t, T.StringType) for t in types):  # cells are their own natural keys
        return raw.select(*[F.col(f"__v{i}").alias(f"__k{i}") for i in range(len(keys))], *firsts, "__first", *results)
    merged = [c.alias(n) for a, names in zip(steps, parts, strict=True) for c, n in zip(a.merge([F.col(n) for n in names]), names, strict=True)]
    least = [F.min_by(f"__v{i}", "__first").alias(f"__v{i}") for i in range(len(keys))]
    out = raw.select("*", *natural).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__first").alias("__first"), *least, *merged)
    return out.select(*heads, *firsts, "__first", *results)


def _named(aggs: Sequence[str | tuple[str, str]]) -> list[tuple[str, str]]:
    return [(a, a) if isinstance(a, str) else a for a in aggs]


def group(table: TableFrame, keys: Sequence[str], aggs: Sequence[str | tuple[str, str]] = ()) -> TableFrame:
    """One row for each natural key, in key order; the key's text is that of its first row.

    ``aggs``: specifications, or (specification, name). A missing key field counts as null.
    """
    named = _named(aggs)
    out = _grouped(table, keys, [spec for spec, _ in named])
    pos = F.struct(*[F.col(f"__k{i}") for i in range(len(keys))], F.col("__first")).alias(POS)
    columns = [F.col(f"__v{i}").alias(k) for i, k in enumerate(keys)] + [F.col(f"__a{i}").alias(n) for i, (_, n) in enumerate(named)]
    return TableFrame(out.select(pos, *columns), (*keys, *[n for _, n in named]))


def _header_cell(v) -> str:
    return "" if v is None else str(v)


def cross(table: TableFrame, vkeys: Sequence[str], hkeys: str | Sequence[str], aggs: str | Sequence[str | tuple[str, str]] = ("count",)) -> TableFrame:
    """Cross tabulation: the ``vkeys``, then for each natural combination of ``hkeys``, in natural
    order, each aggregate; cells without rows are null. Rows are grouped once, by all keys, and
    only the small result is turned. A column is named by its ``hkeys`` cells, and by its aggregate where there are several."""
    out, heads, names = _crossed(table, vkeys, hkeys, aggs)
    columns = [".".join([*map(_header_cell, h), *([n] if len(names) > 1 else [])]) for h in heads for n in names]
    at = out.columns
    pos = F.struct(*[F.col(f"__k{i}") for i in range(len(vkeys))], F.col("__first")).alias(POS)
    cells = at[2 * len(vkeys) + 1 :]
    kept = {n: c for n, c in zip(columns, cells, strict=True)}
    return TableFrame(out.select(pos, *[F.col(f"__v{i}").alias(k) for i, k in enumerate(vkeys)], *[F.col(c).alias(n) for n, c in kept.items()]), (*vkeys, *kept))


def _crossed(table: TableFrame, vkeys: Sequence[str], hkeys: str | Sequence[str], aggs: str | Sequence[str | tuple[str, str]]) -> tuple[DataFrame, list[tuple], list[str]]:
    """(rows, column cells, aggregate names); the rows have __k and __v of the vkeys, __first, and
    a column for each combination of the hkeys and aggregate, in this order."""
    hkeys = [hkeys] if isinstance(hkeys, str) else list(hkeys)
    named = _named([aggs] if isinstance(aggs, str) else aggs)
    if missing := [f for f in (*vkeys, *hkeys) if f not in table.fields]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    n, m = len(vkeys), len(hkeys)
    long = written(_grouped(table, [*vkeys, *hkeys], [spec for spec, _ in named]), "cross")  # read for the header, then for the cells
    tops = [f"__k{i}" for i in range(n, n + m)]
    found = long.groupBy(*tops).agg(*[F.min_by(f"__v{i}", "__first").alias(f"__v{i}") for i in range(n, n + m)])
    found = found.withColumn("__h", F.row_number().over(Window.orderBy(*tops)) - 1)  # a row a column
    rows = found.orderBy("__h").limit(CROSS_COLUMNS + 1).collect()
    if len(rows) > CROSS_COLUMNS:
        raise ValueError(f"a cross table of more than {CROSS_COLUMNS} columns")
    place = found.select("__h", *[F.col(t).alias(f"h{t}") for t in tops])
    long = long.join(F.broadcast(place), reduce(lambda p, q: p & q, [F.col(t).eqNullSafe(F.col(f"h{t}")) for t in tops]))
    columns = []
    for c in range(len(rows)):
        here = F.col("__h") == c
        columns += [F.max_by(F.when(here, F.col(f"__a{j}")), F.when(here, F.lit(1))).alias(f"__c{len(columns) + j}") for j in range(len(named))]
    least = [F.min_by(f"__v{i}", "__first").alias(f"__v{i}") for i in range(n)]
    out = long.groupBy(*[f"__k{i}" for i in range(n)]).agg(*least, F.min("__first").alias("__first"), *columns)
    return out, [tuple(r[m : 2 * m]) for r in rows], [name for _, name in named]


def cross_rows(table: TableFrame, vkeys: Sequence[str], hkeys: str | Sequence[str], aggs: str | Sequence[str | tuple[str, str]] = ("count",), compact: bool = False) -> DataFrame:
    """The cross table as positional text rows (row, "1", "2", ...): for each of the ``hkeys`` a row of its
    cells, a row of field names, then the body; compact puts the last key's cells into the name row."""
    hkeys = [hkeys] if isinstance(hkeys, str) else list(hkeys)
    out, heads, names = _crossed(table, vkeys, hkeys, aggs)
    n, width = len(vkeys), len(vkeys) + len(heads) * len(names)
    text = {f.name: f.dataType for f in out.schema.fields}
    top = [[*[None] * (n - 1), h, *[None if x[i] is None else str(x[i]) for x in heads for _ in names]] for i, h in enumerate(hkeys)]
    last = [None if x[-1] is None else str(x[-1]) if compact else name for x in heads for name in names] if compact else [name for _ in heads for name in names]
    top = [*(top[:-1] if compact else top), [*vkeys, *last]]
    columns = [*[f"__v{i}" for i in range(n)], *out.columns[2 * n + 1 :]]
    positions = [str(i + 1) for i in range(width)]
    schema = T.StructType([T.StructField("row", T.LongType()), *[T.StructField(p, T.StringType()) for p in positions]])
    first = table.df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(top)], schema)
    pos = F.struct(*[F.col(f"__k{i}") for i in range(n)], F.col("__first")).alias(POS)
    body = TableFrame(out.select(pos, *[cell_text(F.col(c), text[c]).alias(p) for c, p in zip(columns, positions, strict=True)]), tuple(positions))
    rows = numbered(body).select((F.col(ROW) + len(top)).alias("row"), *[field(p) for p in positions])
    return first.unionByName(rows)


def categorize(table: TableFrame, *keys: str, value: str | None = None, zero: Column | None = None, step: Callable | None = None,
               result: Callable | None = None, compare: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For each combination of keys, its rows (or one field of them) in order, as an array ``rows``.

    ``compare(a, b)``, an integer Column below, at or above 0, puts them in another order; ``zero``
    and ``step`` (and ``result``) fold them into ``value`` instead, in row order. A category is gathered.
    """
    item = field(value) if value else F.struct(*[field(f) for f in table.fields])
    if step is not None:
        out = folded(item, zero, step, result).alias(value or "value")
    else:
        rows = in_order(item)
        out = (F.array_sort(rows, compare) if compare else rows).alias("rows")
    return table.df.groupBy(*[field(k) for k in keys]).agg(out)


def unique_categorize(table: TableFrame, *keys: str, value: str, zero: Column | None = None, step: Callable | None = None) -> DataFrame:
    """One value for each combination of keys; a second one raises "ambiguous key", unless a fold
    (``zero``, ``step``) makes one of them."""
    if step is not None:
        return categorize(table, *keys, value=value, zero=zero, step=step)
    one = F.when(F.count(F.lit(1)) == 1, F.any_value(field(value))).otherwise(F.raise_error(F.lit("ambiguous key")))
    return table.df.groupBy(*[field(k) for k in keys]).agg(one.alias(value))


def category_count(table: TableFrame, *keys: str) -> DataFrame:
    return table.df.groupBy(*[field(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
