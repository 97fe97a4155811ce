"""melt, unmelt, nest, unnest, header merging and table shapes."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.frame import ABSENT, POS, WIDTH, TableFrame, field, header
from rowloom.functions.natural import cell_text, natural_key
from rowloom.operators.rows import ROW, islands, numbered
from rowloom.sources.formats import csv_cells
from rowloom.workspace import let_workers_import


def melt(table: TableFrame, keys: Sequence[str], fields: Sequence[str] = (), regexps: Sequence[str] = (), recnum: str | None = None,
         variable: str = "variable", value: str = "value") -> TableFrame:
    """One row for each remaining field that a row has, in order, values as text and nulls kept.
    ``fields`` and ``regexps`` (matching whole names) choose the fields; ``recnum`` names a first column with the record's number from 1."""
    chosen = [f for f in table.fields if f not in keys]
    if fields or regexps:
        chosen = [f for f in chosen if f in fields or any(re.fullmatch(r, f) for r in regexps)]
    src = numbered(table) if recnum else table.df
    pairs = F.array(*[F.struct(F.lit(f).alias("k"), cell_text(field(f), table.dtype(f)).alias("v")) for f in chosen])
    if table.ragged:
        pairs = F.filter(pairs, lambda x: ~F.array_contains(ABSENT, x["k"]))
    kept = [field(k) if k in table.fields else F.lit(None).cast("string").alias(k) for k in keys]
    number = [(F.col(ROW) + 1).alias(recnum)] if recnum else []
    out = src.select(POS, *number, *kept, F.posexplode(pairs).alias("__i", "__kv"))
    pos = F.struct(F.col(POS).alias("p"), F.col("__i").alias("i")).alias(POS)
    names = [*([recnum] if recnum else []), *keys, variable, value]
    return TableFrame(out.select(pos, *[field(n) for n in names[:-2]], F.col("__kv.k").alias(variable), F.col("__kv.v").alias(value)), tuple(names))


def unmelt(table: TableFrame, keys: Sequence[str] | None = None, recnum: str | None = None, variable: str = "variable", value: str = "value",
           missing: str | None = None, names: Sequence[str] | None = None) -> TableFrame:
    """Neighbouring rows with equal keys become one row with a column for each variable; a
    variable that comes again begins a new row. ``names`` saves the pass that finds the variables."""
    keys = [f for f in (keys or table.fields) if f not in (variable, value, recnum)]
    runs = islands(table, F.struct(*[field(k) for k in [*keys, *([recnum] if recnum else [])]], F.lit(0).alias("__any")))
    if names is None:
        found = table.df.groupBy(field(variable).alias("v")).agg(F.min(POS).alias("p")).orderBy("p")
        names = [n for n in header(found.select("v")) if n not in keys]
    cells = F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("row"), field(variable).alias("k"), field(value).cast("string").alias("v"))))
    # A greedy scan: the accumulator holds the open record's names and the records so far.
    entry = "array<struct<k:string,v:string>>"
    start = F.struct(F.array().cast(entry).alias("open"), F.array().cast(f"array<{entry}>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.exists(acc["open"], lambda o: o["k"].eqNullSafe(x["k"])) | F.array_contains(F.array(*[F.lit(k) for k in keys], F.lit("")), x["k"])
        item = F.array(F.struct(x["k"].alias("k"), x["v"].alias("v")))
        return F.struct(
            F.when(seen, item).otherwise(F.concat(acc["open"], item)).alias("open"),
            F.when(seen & (F.size(acc["open"]) > 0), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    records = F.aggregate("cells", start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    grouped = runs.groupBy("__island1").agg(F.min(ROW).alias("at"), *[F.min_by(field(k), F.col(ROW)).alias(k) for k in keys], cells.alias("cells"))
    out = grouped.select("at", *[field(k) for k in keys], F.posexplode(records).alias("__i", "rec"))

    def cell(n: str) -> Column:
        got = F.element_at(F.map_from_entries("rec"), n)
        return (F.coalesce(got, F.lit(missing)) if missing is not None else got).alias(n)

    pos = F.struct(F.col("at").alias("p"), F.col("__i").alias("i")).alias(POS)
    lacking = [] if missing is not None else [F.array_except(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.transform("rec", lambda x: x["k"])).alias(ABSENT)]
    return TableFrame(out.select(pos, *lacking, *[field(k) for k in keys], *[cell(n) for n in names]), (*keys, *names))


def csv_cell(text: Column) -> Column:
    """A text cell as CSV: nothing for null, quotes where they are needed."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.isNull(), F.lit("")).when((text == "") | text.rlike('[",\\r\\n]') | text.rlike(r"\A\s|\s\z"), quoted).otherwise(text)


def _csv_line(cells: list[Column]) -> Column:
    return F.concat(F.array_join(F.array(*[csv_cell(c) for c in cells]), ","), F.lit("\n"))


def nest(table: TableFrame, new: str, olds: Sequence[str], as_csv: bool = True) -> TableFrame:
    """Neighbouring rows whose other fields are naturally equal become one row, with the old
    fields as a nested table in a last column: a CSV document, or an array of structs."""
    if missing := [f for f in olds if f not in table.fields]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    rest = [f for f in table.fields if f not in olds and f != new]
    runs = islands(table, F.struct(*[natural_key(field(f), table.dtype(f)).alias(f"k{i}") for i, f in enumerate(rest)], F.lit(0).alias("__any")))
    item = _csv_line([cell_text(field(f), table.dtype(f)) for f in olds]) if as_csv else F.struct(*[field(f) for f in olds])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("p"), item.alias("v")))), lambda x: x["v"])
    nested = F.concat(_csv_line([F.lit(f) for f in olds]), F.array_join(rows, "")) if as_csv else rows
    out = runs.groupBy("__island1").agg(F.min(ROW).alias(POS), *[F.min_by(field(f), F.col(ROW)).alias(f) for f in rest], nested.alias(new))
    return TableFrame(out.select(POS, *[field(f) for f in [*rest, new]]), (*rest, new))


def _csv_rows(text: str | None) -> list[list[tuple[str, str | None]]]:
    rows = csv_cells(text or "")
    return [list(dict(zip(rows[0], r, strict=False)).items()) for r in rows[1:] if r] if rows else []


def unnest(table: TableFrame, name: str, prefix: str = "", outer: bool = False, names: Sequence[str] | None = None) -> TableFrame:
    """Rows of the nested tables in a field (CSV documents or arrays of structs), their fields in
    its place; a nested field hides an outer one of its name. Empty ones drop the row unless ``outer``."""
    if name not in table.fields:
        raise ValueError(f"unknown field: {name}")
    if table.df.schema[name].dataType.typeName() == "array":
        names = [f.name for f in table.df.schema[name].dataType.elementType.fields]
        items = field(name)
        pick = lambda n: F.col("__x")[n]
    else:
        let_workers_import(table.df.sparkSession)
        parse = F.udf(_csv_rows, "array<array<struct<k:string,v:string>>>", useArrow=True)  # batches, not rows, go to Python
        items = F.transform(parse(field(name)), F.map_from_entries)
        if names is None:
            heads = table.df.select(POS, F.explode(items).alias("m")).select(POS, F.posexplode(F.map_keys("m")).alias("i", "n"))
            found = heads.groupBy("n").agg(F.min(F.struct(POS, "i")).alias("p")).orderBy("p")
            names = header(found.select("n"))
        pick = lambda n: F.col("__x")[n]
    new = [prefix + n for n in names]
    at = table.fields.index(name)
    before, after = ([f for f in part if f not in new] for part in (table.fields[:at], table.fields[at + 1 :]))
    explode = F.posexplode_outer if outer else F.posexplode
    out = table.df.select(POS, *[field(f) for f in [*before, *after]], explode(items).alias("__i", "__x"))
    pos = F.struct(F.col(POS).alias("p"), F.coalesce("__i", F.lit(0)).alias("i")).alias(POS)
    return TableFrame(out.select(pos, *[field(f) for f in before], *[pick(n).alias(prefix + n) for n in names], *[field(f) for f in after]), (*before, *new, *after))


def _header_ends(rows: Iterator[list], count: int | None) -> tuple[int, list[str]] | None:
    """After how many rows all columns have different names, and these; None if they never have.

    Of each column its name so far and its last cell are kept: rows are read one at a time."""
    names: list[list[str]] = []
    last: list = []
    for k, cells in enumerate(rows, 1):
        for i, v in enumerate(cells):
            if i == len(names):
                names.append([])
                last.append(...)
            if last[i] is ... or last[i] != v:
                last[i] = v
                if v is not None:
                    names[i] = [" ".join([*names[i], v])]
        merged = ["".join(n).strip() for n in names]
        if k == count or count is None and len(set(merged)) == len(merged):
            return k, merged
    return None


def mheader(grid: DataFrame, count: int | None = None) -> tuple[list[str], DataFrame]:
    """Merge the first rows of a grid (row from 0, cells) into one header: for each column its
    cells, neighbouring repeats left out, joined by a blank. ``count`` rows, or the fewest that make
    all names differ. Returns the names and the other rows; where names never differ, none, with a warning."""
    ordered = grid.orderBy("row").select("cells")
    at, step = None, 64
    while at is None:  # ever more rows, from the top, until the names differ or rows end
        seen = 0

        def rows() -> Iterator[list]:
            nonlocal seen
            for r in ordered.limit(step).toLocalIterator():
                seen += 1
                yield r["cells"]

        at = _header_ends(rows(), count)
        if seen < step:
            break
        step *= 16
    if at is None:
        warnings.warn("no header rows with different names", stacklevel=2)
        return [], grid.limit(0)
    k, names = at
    return names, grid.where(F.col("row") >= k).withColumn("row", F.col("row") - k)


def shape(tables: Sequence[tuple[str, TableFrame]]) -> DataFrame:
    """For each table: filename, records, the fewest and most cells that a row has (null without
    rows), and for tables with a header line the number of its fields, and the fewest and most
    fields that a line has, those beyond the header included; null for all other tables."""
    parts = []
    for name, t in tables:
        pairs = F.lit(len(t.fields)) - (F.size(ABSENT) if t.ragged else F.lit(0))
        width = F.col(WIDTH) if WIDTH in t.df.columns else F.lit(None).cast("int")
        told = F.lit(t.header_width).cast("long")
        parts.append(t.df.agg(
            F.lit(name).alias("filename"), F.count(F.lit(1)).alias("records"), F.min(pairs).cast("long").alias("min_pairs"), F.max(pairs).cast("long").alias("max_pairs"),
            F.min(width).cast("long").alias("min_fields"), F.max(width).cast("long").alias("max_fields"),
        ).select("filename", "records", "min_pairs", "max_pairs", told.alias("header_fields"), "min_fields", "max_fields"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def grid_shape(grid: DataFrame) -> DataFrame:
    """records, min_fields, max_fields of a grid."""
    return grid.agg(F.count(F.lit(1)).alias("records"), F.min(F.size("cells")).cast("long").alias("min_fields"), F.max(F.size("cells")).cast("long").alias("max_fields"))
