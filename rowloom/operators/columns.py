"""Verbs that act row by row: cut, rename, newfield, search, gsub, cat."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.frame import ABSENT, POS, TableFrame, field
from rowloom.functions.patterns import jvm_pattern, jvm_replacement
from rowloom.operators.rows import ROW, numbered


def cut(table: TableFrame, fields: Sequence[str], invert: bool = False) -> TableFrame:
    """Only these fields, in this order (unknown ones are empty columns); inverted, all others."""
    if invert:
        kept = [f for f in table.fields if f not in set(fields)]
    else:
        kept = list(dict.fromkeys(fields))
    cols = [field(f) if f in table.fields else F.lit(None).cast("string").alias(f) for f in kept]
    hidden = table.hidden()
    if table.ragged:
        unknown = F.array(*[F.lit(f) for f in kept if f not in table.fields]).cast("array<string>")
        hidden[1] = F.concat(F.array_intersect(ABSENT, F.array(*[F.lit(f) for f in kept]).cast("array<string>")), unknown).alias(ABSENT)
    return table.having(table.df.select(*hidden, *cols), kept)


def rename(table: TableFrame, pairs: Sequence[tuple[str, str]]) -> TableFrame:
    """All renamings at once, so names can be swapped; of equal new names the last column wins."""
    names = dict(pairs)
    if missing := [s for s in names if s not in table.fields]:
        raise ValueError(f"unknown fields: {', '.join(missing)}")
    last = {names.get(f, f): f for f in table.fields}
    order = list(dict.fromkeys(names.get(f, f) for f in table.fields))
    hidden = table.hidden()
    if table.ragged:
        lost = F.array(*[F.struct(F.lit(last[n]).alias("old"), F.lit(n).alias("new")) for n in order])
        hidden[1] = F.transform(F.filter(lost, lambda x: F.array_contains(ABSENT, x["old"])), lambda x: x["new"]).alias(ABSENT)
    return table.having(table.df.select(*hidden, *[field(last[n]).alias(n) for n in order]), order)


def newfield(table: TableFrame, name: str, value=None, expr: str | Column | Callable | None = None) -> TableFrame:
    """A first column: a constant, an SQL expression, or a Column; a field of that name that exists keeps its values."""
    new = F.lit(value) if expr is None else F.expr(expr) if isinstance(expr, str) else expr(field) if callable(expr) and not isinstance(expr, Column) else expr
    if name in table.fields:
        new = field(name)
    rest = [f for f in table.fields if f != name]
    return table.having(table.df.select(*table.hidden(), new.alias(name), *[field(f) for f in rest]), [name, *rest])


def _text(table: TableFrame, name: str) -> Column:
    return field(name).cast("string")


def search(table: TableFrame, regex: str | None = None, name: str | None = None, invert: bool = False, expr: str | Column | None = None) -> TableFrame:
    """Rows in which a cell (or the named one) matches; or for which an expression holds."""
    if expr is not None:
        hit = F.expr(expr) if isinstance(expr, str) else expr
    elif name is not None:
        hit = _text(table, name).rlike(jvm_pattern(regex)) if name in table.fields else F.lit(False)
    else:
        hit = reduce(lambda a, b: a | b, [F.coalesce(_text(table, f), F.lit("")).rlike(jvm_pattern(regex)) for f in table.fields], F.lit(False))
    hit = F.coalesce(hit, F.lit(False))
    return table.having(table.df.where(~hit if invert else hit))


def gsub(table: TableFrame, regex: str, replacement: str, name: str | None = None) -> TableFrame:
    """Replace matches in every cell, or in one field; null becomes '', what a row lacks it goes on lacking."""
    def new(f: str) -> Column:
        if name is not None and f != name:
            return field(f)
        out = F.regexp_replace(F.coalesce(_text(table, f), F.lit("")), F.lit(jvm_pattern(regex)), F.lit(jvm_replacement(replacement)))
        return (F.when(table.present(f), out) if table.ragged else out).alias(f)

    return table.having(table.df.select(*table.hidden(), *[new(f) for f in table.fields]))


def cat(tables: Sequence[TableFrame], names: Sequence[str] | None = None) -> TableFrame:
    """Rows of all tables one after the other; fields are united in the order they appear.
    With ``names``, a first column ``filename``. Columns of different types become text. Tables
    whose ordinals have different types are numbered first."""
    fields = list(dict.fromkeys(f for t in tables for f in t.fields))
    types: dict[str, T.DataType] = {}
    for t in tables:
        for f in t.fields:
            types[f] = T.StringType() if f in types and types[f] != t.dtype(f) else t.dtype(f)
    parts = []
    kinds = {t.df.schema[POS].dataType.json() for t in tables}
    if len(kinds) > 1:  # such as of a list in memory and a file
        tables = [t.having(numbered(t).drop(POS).withColumnRenamed(ROW, POS)) for t in tables]
    for i, t in enumerate(tables):
        cols = [field(f).cast(types[f]).alias(f) if f in t.fields else F.lit(None).cast(types[f]).alias(f) for f in fields]
        head = [F.lit(names[i]).alias("filename")] if names else []
        lacking = F.array(*[F.lit(f) for f in fields if f not in t.fields]).cast("array<string>")
        lacking = [(F.concat(ABSENT, lacking) if t.ragged else lacking).alias(ABSENT)] if any(u.ragged for u in tables) else []
        parts.append(t.df.select(F.struct(F.lit(i).alias("t"), F.col(POS).alias("p")).alias(POS), *lacking, *head, *cols))
    return TableFrame(reduce(lambda a, b: a.unionByName(b), parts), ("filename", *fields) if names else tuple(fields))
