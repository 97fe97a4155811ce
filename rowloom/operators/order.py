"""Sorting, cropping, sliding windows and control breaks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.frame import POS, TableFrame, field
from rowloom.functions.natural import natural_key
from rowloom.operators.groups import group
from rowloom.operators.rows import ROW, islands, numbered, with_following
from rowloom.workspace import let_workers_import, written


def sort_keys(table: TableFrame, fields: Sequence[str] | None = None, reverse: bool = False) -> list[Column]:
    keys = [natural_key(field(f), table.dtype(f)) for f in (fields or table.fields)]
    return [k.desc_nulls_last() for k in keys] if reverse else [k.asc_nulls_first() for k in keys]


def sort(table: TableFrame, fields: Sequence[str] | None = None, reverse: bool = False) -> DataFrame:
    """Rows in natural order of the fields (all by default); equal rows keep their order."""
    return table.df.orderBy(*sort_keys(table, fields, reverse), POS).select(*[field(f) for f in table.fields])


def sort_unique(table: TableFrame, fields: Sequence[str], aggs: Sequence[str | tuple[str, str]] = ()) -> DataFrame:
    """Rows in natural order of the fields, those with equal ones merged by aggregates
    (user aggregates included); merging is partial before the exchange."""
    return group(table, fields, aggs).ordered()


#: Sampled rows for each part of a sort by a comparator.
SAMPLED = 32


def sort_with(table: TableFrame, compare: Callable[[dict, dict], int], parts: int | None = None) -> TableFrame:
    """Rows in the order of ``compare(a, b)``, below, at or above 0 for rows as dicts of their fields;
    equal rows keep their order.

    Bounds come from a written sample of rows, each with its number, so that equal rows can be split too; rows
    are dealt to ``parts`` (by default the shuffle partitions) by looking their place among the bounds up, and each part is
    sorted in a task of its own. For orders that no key expresses: rows go through Python.
    """
    spark = table.df.sparkSession
    let_workers_import(spark)
    rows = written(numbered(table).select(ROW, *[field(f) for f in table.fields]), "unsorted")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def both(a: dict, b: dict) -> int:
        return compare(a, b) or a[ROW] - b[ROW]

    sample = [r.asDict() for r in rows.orderBy(F.xxhash64(ROW)).limit(SAMPLED * parts).collect()]
    bounds = sorted(sample, key=cmp_to_key(both))[SAMPLED::SAMPLED]

    def dealt(frames: Iterator) -> Iterator:
        key = cmp_to_key(both)
        marks = [key(b) for b in bounds]
        for frame in frames:
            frame["__part"] = [bisect_right(marks, key(r)) for r in _dicts(frame)]
            yield frame

    def ordered(frame):
        frame = frame.reset_index(drop=True)
        records = _dicts(frame)
        key = cmp_to_key(both)
        order = sorted(range(len(records)), key=lambda i: key(records[i]))
        out = frame.iloc[order].copy()
        out["__in"] = range(len(out))
        return out

    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.LongType())])
    placed = rows.mapInPandas(dealt, schema).groupBy("__part").applyInPandas(ordered, T.StructType([*schema.fields, T.StructField("__in", T.LongType())]))
    return table.having(placed.select(F.struct("__part", "__in").alias(POS), *[field(f) for f in table.fields]))


def _dicts(frame) -> list[dict]:
    """Rows with None for what is missing."""
    return frame.astype(object).where(frame.notna(), None).to_dict("records")


def ranked(table: TableFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The fields and ``rank``, the row's place (from 1) in natural order."""
    keys = [natural_key(field(f), table.dtype(f)) for f in (fields or table.fields)]
    again = table.having(table.df.withColumn(POS, F.struct(*keys, F.col(POS))))
    return numbered(again).select(*[field(f) for f in table.fields], (F.col(ROW) + 1).alias("rank"))


def consecutive(table: TableFrame, n: int = 2) -> TableFrame:
    """Every n neighbouring rows as one: f_1 .. f_n for each field f."""
    columns = {f"{f}_{i + 1}": F.lead(field(f), i) for f in table.fields for i in range(n)}
    out = with_following(numbered(table), n, {**columns, "__last": F.lead(F.lit(1), n - 1)})
    return TableFrame(out.where(F.col("__last").isNotNull()).select(F.col(ROW).alias(POS), *[field(c) for c in columns]), tuple(columns))


def control_break(table: TableFrame, *keys: str) -> DataFrame:
    """The fields with run1, run2, ...: numbers of the runs of equal keys, inner runs ending with outer ones."""
    out = islands(table, *[field(k) for k in keys])
    return out.select(F.col(ROW).alias("row"), *[field(f) for f in table.fields], *[F.col(f"__island{i + 1}").alias(f"run{i + 1}") for i in range(len(keys))])


def cell_range(text: str) -> tuple[int, int, int, int]:
    """(row, column, row, column), from 1, of "R1C1:R2C2" or "A1:B2"."""
    def one(x: str) -> tuple[int, int]:
        if m := re.fullmatch(r"[Rr](\d+)[Cc](\d+)", x):
            return int(m[1]), int(m[2])
        if m := re.fullmatch(r"([A-Za-z]+)(\d+)", x):
            column = 0
            for c in m[1].upper():
                column = column * 26 + ord(c) - 64
            return int(m[2]), column
        raise ValueError(f"not a cell: {x}")

    a, _, b = text.partition(":")
    return *one(a), *one(b or a)


def crop(grid: DataFrame, area: str | None = None) -> DataFrame:
    """Cut a grid (row from 0, cells array<string>) to an area; without one, to what is not blank.

    Blank cells are null or ''. Leading and trailing blank rows, blank left columns and blank
    trailing cells of each row go; rows are numbered anew.
    """
    if area:
        r1, c1, r2, c2 = cell_range(area)
        return grid.where(F.col("row").between(r1 - 1, r2 - 1)).select((F.col("row") - (r1 - 1)).alias("row"), F.slice("cells", c1, max(0, c2 - c1 + 1)).alias("cells"))
    ink = F.transform("cells", lambda c: F.coalesce(c, F.lit("")) != "")
    left = F.array_position(ink, True)
    right = F.size(ink) - F.array_position(F.reverse(ink), True) + 1
    marked = grid.select("row", "cells", left.alias("l"), F.when(left > 0, right).otherwise(0).alias("r"))
    bounds = marked.where("l > 0").agg(F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("l").alias("margin"))
    rows = marked.join(F.broadcast(bounds), F.col("row").between(F.col("top"), F.col("bottom")))
    return rows.select((F.col("row") - F.col("top")).alias("row"), F.slice("cells", F.col("margin").cast("int"), F.greatest(F.lit(0), F.col("r") - F.col("margin") + 1).cast("int")).alias("cells"))
