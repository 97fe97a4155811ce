"""Spreadsheet workbooks (``.xlsx``: zipped XML) as grids of cells."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.order import cell_range
from rowloom.sources.readers import whole_files

# Name spaces of the parts of a workbook.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _text(element: ElementTree.Element | None) -> str:
    return "" if element is None else "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def _cell(c: ElementTree.Element, shared: list[str]) -> str | None:
    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return _text(c.find(f"{_MAIN}is"))
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    return value.text


def sheet_cells(data: bytes, merged: str = "fill") -> Iterator[tuple[str, list[list[str | None]]]]:
    """(name, rows) of each sheet. A merged area has its text in all its cells ("fill") or in the
    first alone ("topleft"); numbers are as stored, cells without a value are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        part = lambda name: ElementTree.fromstring(book.read(name))
        shared = [_text(s) for s in part("xl/sharedStrings.xml").findall(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        target = {r.get("Id"): r.get("Target") for r in part("xl/_rels/workbook.xml.rels")}
        for sheet in part("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            where = target[sheet.get(_LINK)]
            tree = part(where.lstrip("/") if where.startswith("/") else posixpath.normpath(f"xl/{where}"))
            cells: dict[tuple[int, int], str | None] = {}
            for y, row in enumerate(tree.iter(f"{_MAIN}row")):
                y = int(row.get("r", y + 1)) - 1
                x = -1
                for c in row.findall(f"{_MAIN}c"):
                    x = cell_range(c.get("r"))[1] - 1 if c.get("r") else x + 1
                    cells[y, x] = _cell(c, shared)
            for area in tree.iter(f"{_MAIN}mergeCell"):
                top, left, bottom, right = (n - 1 for n in cell_range(re.sub(r"\$", "", area.get("ref"))))
                first = cells.get((top, left))
                for y in range(top, bottom + 1):
                    for x in range(left, right + 1):
                        if (y, x) != (top, left):
                            cells[y, x] = first if merged == "fill" else None
            rows: list[list[str | None]] = [[] for _ in range(max((y for y, _ in cells), default=-1) + 1)]
            for (y, x), v in sorted(cells.items()):
                rows[y] += [None] * (x + 1 - len(rows[y]))
                rows[y][x] = v
            yield sheet.get("name"), rows


def workbook(spark: SparkSession, path: str, merged: str = "fill") -> DataFrame:
    """(file, sheet, at, row, cells) of all sheets of the workbooks of a path, a task a file; at
    and row number the sheets of a file and the rows of a sheet from 0."""
    if merged not in ("fill", "topleft"):
        raise ValueError(f"not a way to show merged cells: {merged}")

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for at, (sheet, rows) in enumerate(sheet_cells(bytes(content), merged)):
                    if rows:
                        yield pd.DataFrame({"file": [file] * len(rows), "sheet": sheet, "at": at, "row": range(len(rows)), "cells": rows})

    return whole_files(spark, path).mapInPandas(parse, "file string, sheet string, at int, row long, cells array<string>")
