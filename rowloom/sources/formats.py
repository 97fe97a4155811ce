"""Which format a table name means, and the text codecs behind the readers and writers."""

from __future__ import annotations

import csv
import io
import json
import re

# Extensions and prefixes that name a format.
FORMATS = ("csv", "tsv", "ltsv", "json", "ndjson", "pnm", "ppm", "pgm", "pbm", "ncsv", "ntsv")

# Characters and how a quoted LTSV key or value writes them.
LTSV_ESCAPES = {"\\": "\\\\", '"': '\\"', "\t": "\\t", "\r": "\\r", "\n": "\\n", "\a": "\\a", "\b": "\\b", "\f": "\\f", "\v": "\\v", "\x1b": "\\e", "\0": "\\0"}
_PLAIN = {v[1]: k for k, v in LTSV_ESCAPES.items()}


def resolve_format(name: str, numeric: bool = False) -> tuple[str, str]:
    """(format, path): a ``fmt:`` prefix, else the extension, else csv. Unknown prefixes are errors."""
    if m := re.match(r"\A([a-z0-9]{2,}):(.*)\Z", name, re.S):
        if m[1] not in FORMATS:
            raise ValueError(f"unknown format: {m[1]}")
        kind, path = m[1], m[2]
    else:
        ext = name.rpartition(".")[2].lower() if "." in name else ""
        kind, path = ext if ext in FORMATS else "csv", name
    if numeric and kind in ("csv", "tsv"):
        kind = "n" + kind
    return ("pnm" if kind in ("ppm", "pgm", "pbm") else kind), path


def field_list(text: str) -> list[str]:
    """Names written as one CSV row; blanks are ''."""
    return next(csv.reader(io.StringIO(text)), [])


def csv_cells(text: str) -> list[list[str | None]]:
    """All rows of a CSV text; an unquoted empty cell is None, a quoted one ''."""
    rows, row, at, n = [], [], 0, len(text)
    while at < n:
        if text[at] == '"':
            end, parts = at + 1, []
            while True:
                q = text.find('"', end)
                if q < 0:
                    raise ValueError("quoted cell does not end")
                parts.append(text[end:q])
                if text[q + 1 : q + 2] == '"':
                    parts.append('"')
                    end = q + 2
                    continue
                at = q + 1
                break
            row.append("".join(parts))
        else:
            end = re.compile(r"[,\r\n]|\Z").search(text, at).start()
            row.append(text[at:end] or None)
            at = end
        if text[at : at + 1] == ",":
            at += 1
            if at == n:
                row.append(None)
            continue
        if text[at : at + 2] == "\r\n":
            at += 2
        elif at < n:
            at += 1
        rows.append([] if row == [None] else row)
        row = []
    if row:
        rows.append(row)
    return rows


def csv_line(cells: list) -> str:
    def one(c) -> str:
        if c is None:
            return ""
        c = str(c)
        return '"' + c.replace('"', '""') + '"' if c == "" or re.search(r'[",\r\n]|^\s|\s$', c) else c

    return ",".join(map(one, cells)) + "\n"


def tsv_line(cells: list) -> str:
    return "\t".join(re.sub(r"[\t\r\n]", " ", "" if c is None else str(c)) for c in cells) + "\n"


def ltsv_quote(text: str, key: bool = False) -> str:
    """A value as it stands, or quoted with escapes when it holds control characters, quotes or
    backslashes (colons too in keys)."""
    if not re.search(r'[\x00-\x1f\x7f"\\]' + ("|:" if key else ""), text):
        return text
    out = "".join(LTSV_ESCAPES.get(c) or (f"\\x{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 or key and c == ":" else c) for c in text)
    return f'"{out}"'


def ltsv_unquote(text: str) -> str:
    if len(text) < 2 or text[0] != '"' or text[-1] != '"':
        return text
    return re.sub(r"\\(x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 3 else _PLAIN.get(m[1], m[1]), text[1:-1])


def ltsv_cells(line: str) -> dict[str, str]:
    out = {}
    for cell in line.rstrip("\r\n").split("\t"):
        m = re.match(r'\A("(?:[^"\\]|\\.)*"|[^:]*):(.*)\Z', cell, re.S)
        if m:
            out[ltsv_unquote(m[1])] = ltsv_unquote(m[2])
    return out


def ltsv_line(record: dict) -> str:
    return "\t".join(f"{ltsv_quote(k, True)}:{ltsv_quote('' if v is None else str(v))}" for k, v in record.items()) + "\n"


def json_cell(v):
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


# --- portable anymaps -------------------------------------------------------------------------


def pnm_rows(data: bytes) -> list[tuple]:
    """(type, x, y, component, value) rows of a P1 to P6 image: meta rows, then a row a sample in [0, 1]."""
    at, tokens, comments = 2, [], []
    kind = data[:2].decode("ascii", "replace")
    if not re.fullmatch("P[1-6]", kind):
        raise ValueError("not a portable anymap")
    need = 2 if kind in ("P1", "P4") else 3
    while len(tokens) < need:
        m = re.compile(rb"\s*(?:#([^\n\r]*)[\r\n]|(\d+))").match(data, at)
        if not m:
            raise ValueError("image header is broken")
        at = m.end()
        if m[1] is not None:
            comments.append(m[1].decode("utf-8", "replace").strip())
        else:
            tokens.append(int(m[2]))
    width, height, top = *tokens[:2], tokens[2] if need == 3 else 1
    if not 0 < top <= 65535:
        raise ValueError("sample maximum out of range")
    parts = {"P1": ["V"], "P4": ["V"], "P2": ["V"], "P5": ["V"], "P3": ["R", "G", "B"], "P6": ["R", "G", "B"]}[kind]
    total = width * height * len(parts)
    if kind == "P1":
        values = [int(c) for c in re.findall(rb"[01]", re.sub(rb"#[^\n\r]*", b"", data[at:]))]
    elif kind in ("P2", "P3"):
        values = [int(c) for c in re.findall(rb"\d+", re.sub(rb"#[^\n\r]*", b"", data[at:]))]
    else:
        raw = data[at + 1 :]
        if kind == "P4":
            line = (width + 7) // 8
            values = [raw[y * line + x // 8] >> (7 - x % 8) & 1 for y in range(height) for x in range(width) if y * line + x // 8 < len(raw)]
        elif top < 256:
            values = list(raw[:total])
        else:
            values = [raw[i] << 8 | raw[i + 1] for i in range(0, min(len(raw) - 1, 2 * total), 2)]
    if len(values) < total:
        raise ValueError("image has too few samples")
    out = [("meta", None, None, "pnm_type", kind), ("meta", None, None, "width", width), ("meta", None, None, "height", height), ("meta", None, None, "max", top)]
    out += [("meta", None, None, "comment", c) for c in comments]
    for i, v in enumerate(values[:total]):
        pixel, c = divmod(i, len(parts))
        out.append(("pixel", pixel % width, pixel // width, parts[c], 1 - v if kind in ("P1", "P4") else v / top))
    return out
