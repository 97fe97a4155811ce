"""Aggregate specifications such as ``sum(price)`` turned into Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.frame import POS, TableFrame, field
from rowloom.functions.natural import INTEGER, is_numeric, natural_key, natural_number, number_text

_SPEC = re.compile(r"\A([a-z_][a-z_0-9]*)(?:\((.*)\))?\Z", re.S)
_NAMES = ("sum", "avg", "min", "max", "values", "uniquevalues", "first", "last", "firstn", "lastn")


@dataclass(frozen=True)
class Aggregate:
    """An aggregate in three steps: ``partial`` columns over the rows of a group, the ``merge`` of
    the partials of several groups (again aggregates), and the ``result`` from the partials."""

    partial: Sequence[Column]
    merge: Callable[[Sequence[Column]], Sequence[Column]]
    result: Callable[[Sequence[Column]], Column]


#: Aggregates that users add: name -> (cell, ordinal) -> Column over the rows of a group.
_USER: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str, build: Callable[[Column, Column], Column]) -> None:
    """Make ``name(field)`` an aggregate; ``build`` gets the field's cell and the row ordinal."""
    if name == "count" or name in _NAMES or not _SPEC.match(name) or "(" in name:
        raise ValueError(f"not a name for an aggregate: {name}")
    _USER[name] = build


def names() -> list[str]:
    """All aggregates that a specification may name."""
    return sorted(["count", *_NAMES, *_USER])


def in_order(cell: Column, pos: Column | None = None) -> Column:
    """The cells of a group as an array, in row order."""
    rows = F.array_sort(F.collect_list(F.struct((F.col(POS) if pos is None else pos).alias("p"), cell.alias("v"))))
    return F.transform(rows, lambda x: x["v"])


def folded(cell: Column, zero: Column, step: Callable[[Column, Column], Column], result: Callable[[Column], Column] | None = None, pos: Column | None = None) -> Column:
    """The cells of a group folded in row order: ``step`` takes what there is and the next cell. For
    user aggregates and categories that no built-in aggregate expresses; a group is gathered."""
    return F.aggregate(in_order(cell, pos), zero, step, result) if result else F.aggregate(in_order(cell, pos), zero, step)


def is_user(spec: str) -> bool:
    m = _SPEC.match(spec.strip())
    return bool(m) and m[1] in _USER


def reversed_order(pos: Column, dtype: T.DataType) -> Column:
    """Sorts the other way round; of an ordinal's parts that are no numbers, as they are."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[reversed_order(pos[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return -pos if is_numeric(dtype) else pos


def _same(merge: Callable) -> Callable[[Sequence[Column]], Sequence[Column]]:
    return lambda parts: [merge(p) for p in parts]


def _listed(cell: Column, result: Callable[[Column], Column]) -> Aggregate:
    """From the cells in row order."""
    return Aggregate(
        [F.collect_list(F.when(cell["keep"], F.struct(cell["p"].alias("p"), cell["v"].alias("v"))))],
        lambda parts: [F.flatten(F.collect_list(parts[0]))],
        lambda parts: result(F.transform(F.array_sort(parts[0]), lambda x: x["v"])),
    )


def decomposed(table: TableFrame, spec: str) -> Aggregate:
    """The steps of one specification; unknown names and fields raise ValueError.

    count; sum(f): null counts as 0; of text cells it is text, an integer of any size unless a
    cell had a fraction; avg(f): nulls ignored, null if all
    are; min(f), max(f): natural order, the first of equal cells, its original text; values(f),
    uniquevalues(f): in row order; first(f), last(f): nulls included; firstn(n,f), lastn(n,f): arrays.
    """
    m = _SPEC.match(spec.strip())
    name, arg = (m[1], m[2]) if m else (None, None)
    if name == "count" and arg is None:
        return Aggregate([F.count(F.lit(1))], _same(F.sum), lambda p: p[0].cast("long"))
    n = None
    if name in ("firstn", "lastn") and arg is not None:
        count, _, arg = arg.partition(",")
        n = int(count)
    if arg is None or name not in (*_NAMES, *_USER):
        raise ValueError(f"unknown aggregate: {spec}")
    if arg not in table.fields:
        raise ValueError(f"unknown field: {arg}")
    cell, dtype, pos = field(arg), table.dtype(arg), F.col(POS)
    if name in _USER:
        return Aggregate([_USER[name](cell, pos)], _same(F.first), lambda p: p[0])
    if name == "sum" and is_numeric(dtype):
        zero = F.lit(0).cast("long" if isinstance(dtype, T.IntegralType) else "double")
        return Aggregate([F.sum(cell)], _same(F.sum), lambda p: F.coalesce(p[0], zero))
    if name == "sum":
        whole = cell.rlike(INTEGER)
        return Aggregate(
            [F.sum(F.when(whole, F.btrim(F.regexp_replace(cell, r"\s", "")).cast("decimal(38,0)"))), F.sum(F.when(~whole, natural_number(cell, dtype)))], _same(F.sum),
            lambda p: F.when(p[1].isNull(), F.coalesce(p[0], F.lit(0).cast("decimal(38,0)")).cast("string")).otherwise(number_text(p[1] + F.coalesce(p[0].cast("double"), F.lit(0.0)))),
        )
    if name == "avg":
        number = natural_number(cell, dtype).cast("double")
        return Aggregate([F.sum(number), F.count(cell)], _same(F.sum), lambda p: F.when(p[1] > 0, p[0] / p[1]))
    if name in ("min", "max") and is_numeric(dtype):
        one = F.min if name == "min" else F.max
        return Aggregate([one(cell)], _same(one), lambda p: p[0])
    if name in ("min", "max"):
        # Of equal keys the earlier row wins, so a maximum prefers small ordinals.
        one, at = (F.min, pos) if name == "min" else (F.max, reversed_order(pos, table.df.schema[POS].dataType))
        item = F.struct(natural_key(cell, dtype).alias("k"), at.alias("p"), cell.alias("v"))
        return Aggregate([one(F.when(cell.isNotNull(), item))], _same(one), lambda p: p[0]["v"])
    if name in ("first", "last"):
        by, one = (F.min_by, F.min) if name == "first" else (F.max_by, F.max)
        return Aggregate([by(cell, pos), one(pos)], lambda p: [by(p[0], p[1]), one(p[1])], lambda p: p[0])
    item = F.struct((cell.isNotNull() | F.lit(n is not None)).alias("keep"), pos.alias("p"), (cell if n is not None else cell.cast("string")).alias("v"))
    if name == "firstn":
        return _listed(item, lambda vs: F.slice(vs, 1, n))
    if name == "lastn":
        return _listed(item, lambda vs: F.slice(vs, F.greatest(F.lit(1), F.size(vs) - n + 1), F.lit(n)))
    return _listed(item, lambda vs: F.array_join(F.array_distinct(vs) if name == "uniquevalues" else vs, ","))


def aggregate(table: TableFrame, spec: str) -> Column:
    """The Column of one specification (see :func:`decomposed`), over the rows of a group."""
    steps = decomposed(table, spec)
    return steps.result(steps.partial)
