"""Writers: text lines made by Spark, in row order; one line a row for csv, tsv, ltsv and ndjson."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.frame import POS, TableFrame, field
from rowloom.functions.natural import cell_text
from rowloom.operators.reshape import csv_cell
from rowloom.sources.formats import LTSV_ESCAPES, csv_line, ltsv_quote, resolve_format, tsv_line


# Escapes of a quoted text in pretty-printed rows.
_PP_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\f": "\\f", "\v": "\\v", "\a": "\\a", "\b": "\\b", "\x1b": "\\e"}


def _json_value(c: Column) -> Column:
    text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(6), F.length(text) - 6)


def _ltsv_quoted(text: Column, key: bool) -> Column:
    special = r'[\x00-\x1f\x7f"\\' + (":]" if key else "]")
    parts = F.regexp_extract_all(text, F.lit(f"({special}|{special.replace('[', '[^', 1)}+)"), 1)

    def shown(x: Column) -> Column:
        out = F.when(~x.rlike(special), x)
        for c, e in LTSV_ESCAPES.items():
            out = out.when(x == c, F.lit(e))
        return out.otherwise(F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(x)), 2, "0")))

    return F.when(text.rlike(special), F.concat(F.lit('"'), F.array_join(F.transform(parts, shown), ""), F.lit('"'))).otherwise(text)


def _line(table: TableFrame, kind: str, pad: bool = False) -> Column:
    """The line of a row; cells that it lacks at its end are left out, unless ``pad``."""
    names = table.fields
    cells = [cell_text(field(f), table.dtype(f)).alias(f) for f in names]

    def ended(texts: list[Column]) -> Column:
        row = F.array(*texts).cast("array<string>")
        if pad or not table.ragged:
            return row
        here = F.reverse(F.array(*[table.present(f) for f in names]).cast("array<boolean>"))
        return F.slice(row, 1, F.when(F.array_position(here, True) > 0, F.size(here) - F.array_position(here, True).cast("int") + 1).otherwise(0))

    if kind in ("csv", "ncsv"):
        return F.array_join(ended([csv_cell(c) for c in cells]), ",")
    if kind in ("tsv", "ntsv"):
        return F.array_join(ended([F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ") for c in cells]), "\t")
    if kind == "ltsv":
        pairs = [F.concat(F.lit(ltsv_quote(f, True) + ":"), _ltsv_quoted(F.coalesce(c, F.lit("")), False)) for f, c in zip(names, cells, strict=True)]
        return F.array_join(F.array(*[F.when(table.present(f), p) for f, p in zip(names, pairs, strict=True)]).cast("array<string>"), "\t")
    between = ",\n  " if kind == "pretty" else ","
    gap = ": " if kind == "pretty" else ":"
    pairs = [F.when(table.present(f), F.concat(F.lit(json.dumps(f, ensure_ascii=False) + gap), _json_value(field(f)))) for f in names]
    body = F.array_join(F.array(*pairs).cast("array<string>"), between)
    if kind == "pretty":
        return F.when(body == "", F.lit("{}")).otherwise(F.concat(F.lit("{\n  "), body, F.lit("\n}")))
    return F.concat(F.lit("{"), body, F.lit("}"))


def _header(table: TableFrame, kind: str) -> str | None:
    return csv_line(list(table.fields)) if kind == "csv" else tsv_line(list(table.fields)) if kind == "tsv" else None


def lines(table: TableFrame, kind: str, pad: bool = False) -> Iterator[str]:
    """The text in row order, a line at a time; the driver holds one partition at a time. JSON is
    an array of objects, ``pretty`` one with a pair a line."""
    ordered = table.df.orderBy(POS).select(_line(table, kind, pad).alias("value"))
    if head := _header(table, kind):
        yield head
    if kind in ("json", "pretty"):
        yield "[\n" if kind == "json" else "["
        before = ""
        for r in ordered.toLocalIterator():
            yield f"{before}{r['value']}"
            before = ",\n"
        yield "\n]\n" if kind == "json" else "]\n"
        return
    for r in ordered.toLocalIterator():
        yield r["value"] + "\n"


def to_pp(table: TableFrame, width: int = 79) -> Iterator[str]:
    """Each row as a literal hash of its filled cells, one pair a line where it is wider than ``width``."""

    def literal(v) -> str:
        if not isinstance(v, str):
            return str(v).lower() if isinstance(v, bool) else str(v)
        text = "".join(_PP_ESCAPES.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in v)
        return '"' + re.sub("#(?=[{$@])", r"\\#", text) + '"'

    for row in table.ordered().toLocalIterator():
        pairs = [f"{literal(k)}=>{literal(v)}" for k, v in zip(table.fields, row, strict=True) if v is not None]
        flat = "{" + ", ".join(pairs) + "}"
        yield (flat if len(flat) <= width else "{" + ",\n ".join(pairs) + "}") + "\n"


def to_pnm(table: TableFrame) -> bytes:
    """An image from rows (type, x, y, component, value): meta rows may give pnm_type, width,
    height, max and comments; what they leave out follows from the pixels.

    Values are shares of the maximum, held to 0..1; pixels without a row are 0. Without a
    pnm_type, components R, G, B mean a pixmap, V a graymap, or a bitmap if all values are 0 or 1; without a
    max, 255, or 65,535 where a value is no multiple of 1/255. Spark aggregates to one value a
    sample (the last row's); only an image's samples, or ValueError, reach the driver.
    """
    value = F.expr("try_cast(value AS double)")
    meta = table.df.where("type = 'meta'").orderBy("__pos").select("component", F.col("value").cast("string")).collect()
    told = {r[0]: r[1] for r in meta if r[0] != "comment"}
    pixels = (
        table.df.where("type = 'pixel'").groupBy(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "component")
        .agg(F.max_by(F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))), "__pos").alias("v"))
    )
    facts = pixels.agg(
        F.max("x"), F.max("y"), F.collect_set("component"), F.min("x"), F.min("y"), F.coalesce(F.bool_and(F.col("v").isin(0.0, 1.0)), F.lit(True)),
        F.coalesce(F.bool_and(F.abs(F.col("v") * 255 - F.round(F.col("v") * 255)) < 1e-6), F.lit(True)), F.count_if(F.col("v").isNull() | F.col("x").isNull() | F.col("y").isNull()),
    ).first()
    width, height = (int(told.get(name) or (-1 if facts[i] is None else facts[i]) + 1) for i, name in enumerate(("width", "height")))
    parts = set(facts[2])
    kind = told.get("pnm_type") or ("P6" if parts & {"R", "G", "B"} else "P4" if facts[5] else "P5")
    names = {"P1": "V", "P2": "V", "P3": "RGB", "P4": "V", "P5": "V", "P6": "RGB"}.get(kind)
    if names is None or parts - set(names) or facts[7] or min(facts[3] or 0, facts[4] or 0) < 0 or (facts[0] or 0) >= max(width, 1) or (facts[1] or 0) >= max(height, 1):
        raise ValueError(f"no {kind} image of {width} x {height} from components {sorted(parts)}")
    bitmap = kind in ("P1", "P4")
    top = 1 if bitmap else int(told.get("max") or (255 if facts[6] else 65535))
    if not 1 <= top <= 65535:
        raise ValueError(f"maximum {top} is not in 1..65535")
    samples = [0] * (width * height * len(names))
    for r in pixels.toLocalIterator():
        raw = int(r["v"] * top + 0.5)
        samples[(r["y"] * width + r["x"]) * len(names) + names.index(r["component"])] = raw
    if bitmap:
        samples = [1 - v for v in samples]
    comments = "".join(f"# {line}\n" for r in meta if r[0] == "comment" for line in (r[1] or "").splitlines())
    head = f"{kind}\n{comments}{width} {height}\n{'' if bitmap else f'{top}\n'}".encode()
    rows = [samples[i : i + width * len(names)] for i in range(0, len(samples), max(1, width * len(names)))]
    if kind in ("P1", "P2", "P3"):
        return head + "".join(" ".join(map(str, row[i : i + 10])) + "\n" for row in rows for i in range(0, len(row), 10)).encode()
    if kind == "P4":
        return head + b"".join(int("".join(map(str, row)).ljust(-(-width // 8) * 8, "0"), 2).to_bytes(-(-width // 8), "big") for row in rows)
    return head + b"".join(v.to_bytes(1 if top < 256 else 2, "big") for row in rows for v in row)


def write(table: TableFrame, spec: str) -> None:
    """Write one local file; a file with the same content is left alone."""
    import os

    kind, path = resolve_format(spec)
    if kind == "pnm":
        with open(path, "wb") as image:
            image.write(to_pnm(table))
        return
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8", newline="") as out:
        out.writelines(lines(table, kind))
    if os.path.exists(path):
        with open(path, "rb") as a, open(part, "rb") as b:
            if a.read() == b.read():
                os.remove(part)
                return
    os.replace(part, path)


def write_folder(table: TableFrame, path: str, kind: str = "csv") -> None:
    """Write a folder of part files in parallel; in the order of their names they hold what one file
    would, the header line first. For csv, ncsv, tsv, ntsv, ltsv and ndjson, which are lines."""
    if kind not in ("csv", "ncsv", "tsv", "ntsv", "ltsv", "ndjson"):
        raise ValueError(f"not a format of lines: {kind}")
    body = table.df.select(F.struct(F.lit(1).alias("part"), F.col(POS).alias("pos")).alias("at"), _line(table, kind).alias("value"))
    if head := _header(table, kind):
        first = table.df.sparkSession.createDataFrame([(head.rstrip("\n"),)], "value string")
        none = F.lit(None).cast(table.df.schema[POS].dataType)
        body = first.select(F.struct(F.lit(0).alias("part"), none.alias("pos")).alias("at"), "value").unionByName(body)
    body.repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def to_yaml(table: TableFrame) -> Iterator[str]:
    yield "---\n"
    for row in table.ordered().toLocalIterator():
        for i, (k, v) in enumerate(row.asDict().items()):
            yield f"{'- ' if not i else '  '}{json.dumps(k, ensure_ascii=False)}: {json.dumps(v, default=str, ensure_ascii=False)}\n"
