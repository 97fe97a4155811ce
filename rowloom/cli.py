"""``python -m rowloom VERB [options] FILE...``: one verb over files, to a file or standard output."""

from __future__ import annotations

import argparse
import os
import shutil
import subprocess
import sys
from collections.abc import Iterable
from itertools import chain
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.frame import TableFrame
from rowloom.operators import columns as C
from rowloom.operators import groups as G
from rowloom.operators import joins as J
from rowloom.operators import order as O
from rowloom.operators import reshape as R
from rowloom.sources.formats import field_list, resolve_format
from rowloom.sources.listings import git_log, list_dir, list_tar, svn_log
from rowloom.sources.readers import numbered_grid, positional, read, read_one
from rowloom.sources.writers import lines, to_pnm, to_pp, to_yaml, write


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rowloom", description="Table verbs on Spark.")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, what: str, *args: tuple) -> None:
        p = verbs.add_parser(name, help=what)
        p.add_argument("-o", "--output")
        p.add_argument("-N", "--numeric", action="store_true", help="files have no header")
        for flags, more in args:
            p.add_argument(*flags, **more)
        p.add_argument("--no-pager", action="store_true")
        p.add_argument("files", nargs="*")

    flag, one = {"action": "store_true"}, {}
    for kind in ("csv", "tsv", "ltsv", "json", "ndjson", "yaml", "pp", "pnm"):
        verb(f"to-{kind}", f"write as {kind}")
    verb("search", "rows that match", (["-f", "--field"], one), (["-v", "--invert"], flag), (["--expr"], one), (["-e", "--regexp"], one))
    verb("gsub", "replace matches", (["-f", "--field"], one), (["regexp"], one), (["replacement"], one))
    verb("sort", "natural order", (["-f", "--fields"], one), (["-r", "--reverse"], flag))
    verb("cut", "choose fields", (["-v", "--invert"], flag), (["fields"], one))
    verb("rename", "rename fields", (["pairs"], one))
    verb("newfield", "add a first field", (["--expr"], flag), (["field"], one), (["value"], one))
    verb("cat", "one after the other", (["-H", "--with-filename"], flag))
    verb("join", "natural join", (["--outer"], flag), (["--left"], flag), (["--right"], flag), (["--outer-missing"], one))
    verb("consecutive", "neighbouring rows as one", (["-n"], {"type": int, "default": 2}))
    verb("group", "group rows", (["-a", "--aggregate"], {"action": "append", "default": []}), (["keys"], one))
    verb("cross", "cross tabulation", (["-a", "--aggregate"], {"action": "append", "default": []}), (["-c", "--compact"], flag), (["vkeys"], one), (["hkeys"], one))
    verb("melt", "wide to long", (["--recnum"], one), (["--melt-regexp"], one), (["--melt-fields"], one), (["keys"], one))
    verb("unmelt", "long to wide", (["--keys"], one), (["--recnum"], one), (["--missing-value"], one))
    verb("nest", "rows into a cell", (["spec"], one))
    verb("unnest", "a cell into rows", (["--outer"], flag), (["--prefix"], {"default": ""}), (["field"], one))
    verb("shape", "rows and fields of files")
    verb("mheader", "merge header rows", (["-c", "--count"], {"type": int}))
    verb("crop", "cut an area", (["-r", "--range"], one))
    verb("ls", "files and directories", (["-l"], {"action": "count", "default": 0}), (["-R", "--recursive"], flag), (["-a", "--all"], flag), (["-A", "--almost-all"], flag))
    verb("tar", "archives", (["-l", "--long"], flag), (["--hash"], {"action": "append", "default": []}))
    verb("git", "commits", (["--git-command"], {"default": "git"}))
    verb("svn", "an XML log, or that of a working copy", (["--svn-command"], one))
    p = verbs.add_parser("help", help="the verbs, or one of them")
    p.add_argument("-s", "--summary", action="store_true")
    p.add_argument("about", nargs="?")
    return top


def help_text(about: str | None = None, summary: bool = False) -> str:
    """How to use a verb; all verbs with a line each where none is named."""
    top = parser()
    verbs = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction))
    if about is None:
        listed = "".join(f"  {c.dest:<12} {c.help}\n" for c in verbs._choices_actions)
        return listed if summary else top.format_usage() + "\n" + listed
    if about not in verbs.choices:
        raise ValueError(f"unknown verb: {about}")
    if summary:
        return f"{about}: {next(c.help for c in verbs._choices_actions if c.dest == about)}\n"
    return verbs.choices[about].format_help()


def _specs(texts: list[str]) -> list[tuple[str, str]]:
    """(specification, name) of each SPEC[,NAME]."""
    parts = [s.split(",", 1) if "(" not in s else [s[: s.index(")") + 1], *filter(None, [s[s.index(")") + 2 :]])] for s in texts]
    return [(p[0], p[-1]) for p in parts]


def table(spark: SparkSession, a: argparse.Namespace) -> TableFrame:
    """The result of the parsed command."""
    v = a.verb
    if v == "ls":
        return list_dir(spark, *a.files, level=a.l, recursive=a.recursive, hidden="all" if a.all else "almost" if a.almost_all else "")
    if v == "tar":
        return C.cat([list_tar(spark, f, a.long, a.hash) for f in a.files]) if len(a.files) > 1 else list_tar(spark, a.files[0], a.long, a.hash)
    if v == "svn":
        return svn_log(spark, a.files[0], a.svn_command)
    if v == "git":
        return git_log(spark, *a.files, command=a.git_command)
    if v in ("crop", "mheader"):
        grids = [numbered_grid(spark, path, "tsv" if kind == "tsv" else "csv") for kind, path in map(resolve_format, a.files)]
        g = grids[0]
        for more in grids[1:]:
            g = g.unionByName(more.withColumn("row", F.col("row") + F.lit(g.count())))
        if v == "crop":
            return positional(O.crop(g, a.range))
        names, rest = R.mheader(g, a.count)
        return C.rename(t := positional(rest), list(zip(t.fields, names, strict=False)))
    if v == "join":
        return J.join([read_one(spark, f, a.numeric) for f in a.files], a.left or a.outer, a.right or a.outer, a.outer_missing)
    if v == "shape":
        return TableFrame.of(R.shape([(f, read_one(spark, f, a.numeric)) for f in a.files]))
    if v == "search" and a.regexp is None and a.expr is None:
        a.regexp, a.files = a.files[0], a.files[1:] or ["-"]
    t = read(spark, *a.files, numeric=a.numeric, with_filename=getattr(a, "with_filename", False))
    names = lambda x: field_list(x) if x else None
    match v:
        case "search":
            return C.search(t, a.regexp, a.field, a.invert, a.expr)
        case "gsub":
            return C.gsub(t, a.regexp, a.replacement, a.field)
        case "sort":
            df = O.ranked(t, names(a.fields))
            return TableFrame(df.withColumn("__pos", -F.col("rank") if a.reverse else F.col("rank")).drop("rank"), t.fields)
        case "cut":
            return C.cut(t, field_list(a.fields), a.invert)
        case "rename":
            p = field_list(a.pairs)
            return C.rename(t, list(zip(p[::2], p[1::2], strict=True)))
        case "newfield":
            return C.newfield(t, a.field, None if a.expr else a.value, a.value if a.expr else None)
        case "consecutive":
            return O.consecutive(t, a.n)
        case "group":
            return G.group(t, field_list(a.keys), _specs(a.aggregate))
        case "cross":
            df = G.cross_rows(t, field_list(a.vkeys), field_list(a.hkeys), _specs(a.aggregate) or ["count"], a.compact)
            return TableFrame(df.withColumnRenamed("row", "__pos"), tuple(df.columns[1:]))
        case "melt":
            return R.melt(t, field_list(a.keys), names(a.melt_fields) or (), [a.melt_regexp] if a.melt_regexp else (), a.recnum)
        case "unmelt":
            return R.unmelt(t, names(a.keys), a.recnum, missing=a.missing_value)
        case "nest":
            new, *olds = field_list(a.spec)
            return R.nest(t, new, olds)
        case "unnest":
            return R.unnest(t, a.field, a.prefix, a.outer)
    return t


def show(text: Iterable[str], out: TextIO | None = None) -> None:
    """Text to standard output; on a terminal, what goes beyond a screen to ``$PAGER``."""
    out = out or sys.stdout
    if not out.isatty():
        out.writelines(text)
        return
    size = shutil.get_terminal_size()
    text, held, rows = iter(text), [], 0
    for part in text:
        held.append(part)
        rows += sum(max(1, -(-len(line.expandtabs()) // size.columns)) for line in part.splitlines())
        if rows > size.lines - 1:
            with subprocess.Popen(os.environ.get("PAGER") or "more", shell=True, stdin=subprocess.PIPE, text=True) as pager:
                try:
                    pager.stdin.writelines(chain(held, text))
                    pager.stdin.close()
                except BrokenPipeError:  # the reader has seen enough
                    pass
            return
    out.writelines(held)


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    """The command; files may stand before and after options, and none means standard input."""
    top = parser()
    a, more = top.parse_known_args(argv)
    if wrong := [x for x in more if x.startswith("-") and x != "-"]:
        top.error(f"unknown options: {' '.join(wrong)}")
    if a.verb != "help":
        a.files = [*a.files, *more] or (["."] if a.verb in ("git", "ls", "svn") else ["-"])
    return a


def main(argv: list[str] | None = None) -> int:
    a = parsed(argv)
    if a.verb == "help":
        print(help_text(a.about, a.summary), end="")
        return 0
    spark = SparkSession.builder.appName("rowloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    result = table(spark, a)
    kind = a.verb[3:] if a.verb.startswith("to-") else None
    headless = a.numeric or a.verb in ("crop", "cross")
    if a.output and kind is None and not headless:
        write(result, a.output)
        return 0
    if kind == "pnm":
        image = to_pnm(result)
        if a.output:
            with open(a.output, "wb") as out:
                out.write(image)
        else:
            sys.stdout.buffer.write(image)
        return 0
    text = to_yaml(result) if kind == "yaml" else to_pp(result) if kind == "pp" else lines(result, "pretty" if kind == "json" else kind or ("ncsv" if headless else "csv"), pad=kind in ("csv", "tsv"))
    if a.output:
        with open(a.output, "w", encoding="utf-8", newline="") as out:
            out.writelines(text)
    elif a.no_pager:
        sys.stdout.writelines(text)
    else:
        show(text)
    return 0
