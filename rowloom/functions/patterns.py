"""Regular expressions in the dialect users write, turned into the JVM's."""

from __future__ import annotations

import re


def jvm_pattern(pattern: str) -> str:
    """``^`` and ``$`` stand for line ends always, and lines end at a line feed alone; ``(?m)`` lets the
    dot match line feeds; ``\\h`` is a hex digit; ``\\Z`` may stand before a last line feed."""
    pattern = re.sub(r"\(\?m([):-])", r"(?s\1", pattern)
    out, at, inside = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            pair = pattern[at : at + 2]
            out.append({r"\h": "0-9a-fA-F" if inside else "[0-9a-fA-F]", r"\Z": r"(?=\n?\z)"}.get(pair, pair))
            at += 2
            continue
        inside += (c == "[") - (c == "]" and inside > 0)
        # The JVM's ^ doesn't stand for the beginning of an empty text.
        out.append(r"(?:\A|^)" if c == "^" and not inside else c)
        at += 1
    return "(?md)" + "".join(out)


def jvm_replacement(text: str) -> str:
    """``\\1`` and ``\\&`` refer to groups; ``$`` is itself."""
    def one(m: re.Match) -> str:
        x = m[0]
        if x == "$":
            return r"\$"
        if x[1:].isdigit():
            return f"${x[1:]}"
        return "$0" if x[1:] == "&" else r"\\" if x[1:] == "\\" else re.sub(r"\$", r"\\$", x[1:])

    return re.sub(r"\$|\\(?s:.)", one, text)
