"""Readers: every format becomes a :class:`TableFrame` whose ordinal keeps the files' row order.

Lines are split by Spark's text scan and parsed by column expressions, so large files are read
by many tasks. Python parses only CSV files in which a quoted cell runs over a line end, and images.
"""

from __future__ import annotations

import shutil
import sys
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.frame import ABSENT, POS, WIDTH, TableFrame, header
from rowloom.operators.columns import cat
from rowloom.operators.rows import ROW, numbered
from rowloom.sources.formats import LTSV_ESCAPES, csv_cells, pnm_rows, resolve_format
from rowloom.workspace import let_workers_import, shared_path


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content), for Python parsers."""
    let_workers_import(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the lines of a file, folder or pattern, without their ends; row orders them by
    file name and place in the file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    return lines.select(place.alias("row"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def _csv_cells(line: Column) -> Column:
    """The cells of a line: null where nothing stands, '' where quotes hold nothing."""
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), 1)
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    cell = lambda c: F.when(c == "", None).when(c.startswith('"'), inner(c)).otherwise(c)
    plain = F.transform(F.split(line, ",", -1), lambda c: F.when(c != "", c))
    return F.when(line == "", F.array().cast("array<string>")).when(line.contains('"'), F.transform(quoted, cell)).otherwise(plain)


def grid(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """(row, cells) of text files without a header; row has the order of lines."""
    lines = text_lines(spark, path)
    if kind == "tsv":
        return lines.select("row", F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(F.split("value", "\t", -1)).alias("cells"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    if not lines.where(quotes % 2 == 1).limit(1).count():
        return lines.select("row", _csv_cells(F.col("value")).alias("cells"))

    def parse(batches: Iterator) -> Iterator:  # a quoted cell goes on in the next line: a task a file
        import pandas as pd

        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = csv_cells(bytes(content).decode("utf-8", "replace"))
                if rows:
                    yield pd.DataFrame({"file": [file] * len(rows), "line": range(len(rows)), "cells": rows})

    whole = whole_files(spark, path).mapInPandas(parse, "file string, line long, cells array<string>")
    return whole.select(F.struct("file", F.lit(0).cast("long").alias("start"), "line").alias("row"), "cells")


def numbered_grid(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """(row, cells) with rows numbered from 0 over all files."""
    g = grid(spark, path, kind)
    return numbered(TableFrame(g.withColumnRenamed("row", POS), ("cells",))).select(F.col(ROW).alias("row"), "cells")


def _lacking(names: list[str], at: list[int]) -> Column:
    """Names of the cells that a row is too short for."""
    short = F.array_compact(F.array(*[F.when(F.size("cells") <= i, F.lit(n)) for n, i in zip(names, at, strict=True)]))
    return F.when(F.size("cells") > max(at, default=-1), F.array().cast("array<string>")).otherwise(short).alias(ABSENT)


def _with_header(g: DataFrame) -> TableFrame:
    """The first row with a filled cell is the header; null names and repeated names are dropped."""
    ink = F.exists("cells", lambda c: F.coalesce(c, F.lit("")) != "")
    first = g.where(ink).orderBy("row").limit(1).collect()
    if not first:
        return TableFrame(g.select(F.col("row").alias(POS)).limit(0), (), 0)
    place, names = first[0]["row"], first[0]["cells"]
    order: dict[str, int] = {}
    for i, n in enumerate(names):
        if n is not None and n not in order:
            order[n] = i
    at = F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("file", "start", "line"), place, ("string", "long", "long"), strict=True)])
    rows = g.where(F.col("row") > at)
    cells = [F.get("cells", F.lit(i)).alias(n) for n, i in order.items()]
    return TableFrame(rows.select(F.col("row").alias(POS), _lacking(list(order), list(order.values())), F.size("cells").alias(WIDTH), *cells), tuple(order), len(names))


def positional(g: DataFrame) -> TableFrame:
    """A grid as a table with fields "1", "2", ..."""
    width = g.agg(F.max(F.size("cells")).alias("n")).first()["n"] or 0
    names = [str(i + 1) for i in range(width)]
    cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
    return TableFrame(g.select(F.col("row").alias(POS), _lacking(names, list(range(width))), *cells), tuple(names))


def _in_order(df: DataFrame) -> list[str]:
    """Names in (row, keys) in the order they first appear; the header, a name a field."""
    keys = df.select("row", F.posexplode("keys").alias("i", "k")).groupBy("k").agg(F.min(F.struct("row", "i")).alias("p")).orderBy("p")
    return header(keys.select("k"))


def _unquoted(text: Column) -> Column:
    """Undo the quotes and escapes of an LTSV key or value."""
    parts = F.regexp_extract_all(F.substring(text, F.lit(2), F.length(text) - 2), F.lit(r"(\\x[0-9A-Fa-f]{2}|\\.|[^\\]+)"), 1)

    def plain(x: Column) -> Column:
        out = F.when(x.rlike(r"\A\\x[0-9A-Fa-f]{2}\z"), F.decode(F.unhex(F.substring(x, 3, 2)), "ISO-8859-1"))
        for c, e in LTSV_ESCAPES.items():
            out = out.when(x == e, F.lit(c))
        return out.when(x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)

    whole = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    return F.when(whole, F.array_join(F.transform(parts, plain), "")).otherwise(text)


def _ltsv(lines: DataFrame) -> TableFrame:
    cell = r'(?s)\A("(?:[^"\\]|\\.)*+"|[^:]*+):(.*)\z'
    cells = F.filter(F.split("value", "\t", -1), lambda c: c.rlike(cell))
    pairs = F.transform(cells, lambda c: F.struct(_unquoted(F.regexp_extract(c, cell, 1)).alias("k"), _unquoted(F.regexp_extract(c, cell, 2)).alias("v")))
    # A key that comes again replaces the value of the first.
    rows = lines.select("row", pairs.alias("pairs")).where(F.size("pairs") > 0)
    rows = rows.select("row", F.array_distinct(F.transform("pairs", lambda p: p["k"])).alias("keys"), F.reverse("pairs").alias("pairs"))
    names = _in_order(rows)
    value = lambda n: F.get(F.filter("pairs", lambda p: p["k"] == n), F.lit(0))["v"]
    lacking = F.array_except(F.array(*[F.lit(n) for n in names]).cast("array<string>"), "keys").alias(ABSENT)
    return TableFrame(rows.select(F.col("row").alias(POS), lacking, *[value(n).alias(n) for n in names]), tuple(names))


def _json(spark: SparkSession, path: str, whole: bool) -> TableFrame:
    """Objects with typed cells; a JSON document is an array of them, of NDJSON a line is one."""
    if whole:
        docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("line", "value"))
        lines = docs.select(F.struct("file", F.lit(0).cast("long").alias("start"), F.col("line").cast("long").alias("line")).alias("row"), "value")
    else:
        lines = text_lines(spark, path).where(F.trim("value") != "")
    rows = lines.withColumn("keys", F.json_object_keys("value"))
    names = _in_order(rows)
    schema = spark.read.option("multiLine", whole).json(path).schema if names else None
    if not names:
        return TableFrame(rows.select(F.col("row").alias(POS)), ())
    parsed = rows.withColumn("rec", F.from_json("value", schema, {"mode": "FAILFAST"}))
    lacking = F.array_except(F.array(*[F.lit(n) for n in names]).cast("array<string>"), "keys").alias(ABSENT)
    return TableFrame(parsed.select(F.col("row").alias(POS), lacking, *[F.col("rec").getField(n).alias(n) for n in names]), tuple(names))


def _spooled(spark: SparkSession) -> str:
    """Standard input as a file that all executors can read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "stdin"))
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where)

    class Sink:
        @staticmethod
        def write(data: bytes) -> None:
            out.write(data)

    shutil.copyfileobj(sys.stdin.buffer, Sink, 1 << 20)
    out.close()
    return where.toString()


def read_one(spark: SparkSession, spec: str, numeric: bool = False) -> TableFrame:
    """The table of one file, folder of part files, pattern, or ``-``, standard input."""
    kind, path = resolve_format(spec, numeric)
    if path == "-":
        path = _spooled(spark)
    if kind in ("csv", "tsv"):
        return _with_header(grid(spark, path, kind))
    if kind in ("ncsv", "ntsv"):
        return positional(grid(spark, path, kind[1:]))
    if kind == "ltsv":
        return _ltsv(text_lines(spark, path))
    if kind in ("json", "ndjson"):
        return _json(spark, path, kind == "json")

    def pixels(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                rows = [(i, t, x, y, c, str(v)) for i, (t, x, y, c, v) in enumerate(pnm_rows(bytes(content)))]
                yield pd.DataFrame(rows, columns=[POS, "type", "x", "y", "component", "value"]).astype({"x": "Int64", "y": "Int64"})

    names = ("type", "x", "y", "component", "value")
    return TableFrame(whole_files(spark, path).mapInPandas(pixels, f"{POS} long, type string, x long, y long, component string, value string"), names)


def read(spark: SparkSession, *specs: str, numeric: bool = False, with_filename: bool = False) -> TableFrame:
    """One table of one or more files, united by field name; standard input where none is named."""
    specs = specs or ("-",)
    tables = [read_one(spark, s, numeric) for s in specs]
    return tables[0] if len(tables) == 1 and not with_filename else cat(tables, list(specs) if with_filename else None)
