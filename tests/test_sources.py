import io
import os
import subprocess
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from rowloom.frame import TableFrame
from rowloom.functions.profile import profile
from rowloom.operators.columns import cat, cut, gsub, rename
from rowloom.operators.reshape import melt, shape, unnest
from rowloom.sources import formats as f
from rowloom.sources.listings import git_log, list_dir, list_tar, svn_log
from rowloom.sources.readers import read
from rowloom.sources.workbook import workbook
from rowloom.sources.writers import lines, to_pnm, to_pp, to_yaml, write


def put(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows(t):
    return [tuple(r) for r in t.ordered().collect()]


def test_csv_states_and_header_repair(spark, tmp_path):
    t = read(spark, put(tmp_path / "a.csv", '\n,,\na,b,,a\n1,,x,9\n"","q ""2""\nline"\n'))
    assert t.fields == ("a", "b")
    assert rows(t) == [("1", None), ("", 'q "2"\nline')]
    assert "".join(lines(t, "csv")) == 'a,b\n1,\n"","q ""2""\nline"\n'


@pytest.mark.parametrize("quoted", ["x", '"p\nq"'])  # lines split by Spark, and a file parsed whole
def test_csv_three_states_of_a_cell(spark, tmp_path, quoted):
    t = read(spark, put(tmp_path / "a.csv", f'a,b,c\n1\n"",,\n\n{quoted},",","say ""hi"""\r\n4,5,6,7\n'))
    assert rows(t) == [("1", None, None), ("", None, None), (None, None, None), (quoted.strip('"'), ",", 'say "hi"'), ("4", "5", "6")]
    assert [r[0] for r in t.df.orderBy("__pos").select("__absent").collect()] == [["b", "c"], [], ["a", "b", "c"], [], []]
    assert "".join(lines(t, "csv")) == f'a,b,c\n1\n"",,\n\n{quoted},",","say ""hi"""\n4,5,6\n'
    assert "".join(lines(t, "csv", pad=True)).startswith('a,b,c\n1,,\n"",,\n,,\n')
    assert [tuple(r) for r in melt(t, ["a"]).ordered().collect()][:3] == [("", "b", None), ("", "c", None), (quoted.strip('"'), "b", ",")]
    assert rows(gsub(t, "^$", "-"))[:2] == [("1", None, None), ("-", "-", "-")]
    assert "".join(lines(rename(cut(t, ["c", "a", "z"]), [("c", "C")]), "csv")).splitlines()[:3] == ["C,a,z", ",1", ',""']
    assert list(lines(t, "ndjson"))[:2] == ['{"a":"1"}\n', '{"a":"","b":null,"c":null}\n']
    assert [tuple(r) for r in shape([("f", t)]).collect()] == [("f", 5, 0, 3, 3, 0, 4)]


def test_cat_of_short_rows(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "a,b\n1,2\n3,4,x\n"), put(tmp_path / "b.csv", "b,c\n5,6\n")
    t = read(spark, a, b)
    assert "".join(lines(t, "csv")) == "a,b,c\n1,2\n3,4\n,5,6\n"
    both = cat([t, TableFrame.from_rows(spark, ["d"], [["z"]])])  # another kind of ordinal
    assert rows(both)[-1] == (None, None, None, "z") and len(rows(both)) == 4


@pytest.mark.parametrize("kind", ["csv", "tsv", "ltsv", "ndjson", "ncsv"])
def test_folders_of_parts(spark, tmp_path, kind):
    n = 20_000
    df = spark.range(n).select(((n - 1) - F.col("id")).alias("id"), F.concat(F.lit("cell "), F.col("id"), F.when(F.col("id") % 7 == 0, ', "q"').otherwise("")).alias("text"))
    t = TableFrame.of(df, ["id"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        t.write_folder(f"{tmp_path}/out", kind)
        back = read(spark, f"{kind}:{tmp_path}/out")
        assert back.df.rdd.getNumPartitions() > 4  # more tasks than files
        assert [tuple(map(str, r)) for r in back.ordered().collect()] == [tuple(map(str, r)) for r in t.ordered().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO("a\tb\n1\t\u00e9\n".encode())))
    assert rows(read(spark, "tsv:-")) == [("1", "\u00e9")]


def test_other_formats(spark, tmp_path):
    assert rows(read(spark, put(tmp_path / "a.tsv", "a\tb\n1\t\n"))) == [("1", "")]
    assert rows(read(spark, put(tmp_path / "a.ndjson", '{"a":1}\n\n{"b":"x"}\n'))) == [(1, None), (None, "x")]
    t = read(spark, put(tmp_path / "a.json", '[{"b":[1,2],"a":1.5,"c":true},{"a":null}]'))
    assert t.fields == ("b", "a", "c") and rows(t) == [([1, 2], 1.5, True), (None, None, None)]
    assert "".join(lines(t, "json")) == '[\n{"b":[1,2],"a":1.5,"c":true},\n{"a":null}\n]\n'
    assert "".join(lines(t, "pretty")) == '[{\n  "b": [1,2],\n  "a": 1.5,\n  "c": true\n},\n{\n  "a": null\n}]\n'
    assert rows(read(spark, put(tmp_path / "a.ltsv", 'k:v\tq:"a\\tb"\nz:\t"k":"\\x41\\\\n\\q"\tk:2\n'))) == [("v", "a\tb", None), ("2", None, "")]
    assert "".join(lines(read(spark, f"{tmp_path}/a.ltsv"), "ltsv")) == 'k:v\tq:"a\\tb"\nk:2\tz:\n'
    assert read(spark, put(tmp_path / "n.csv", "1,2,3\n4\n"), numeric=True).fields == ("1", "2", "3")
    with pytest.raises(ValueError):
        f.resolve_format("nosuch:x")


def test_ltsv_written_by_spark(spark, tmp_path):
    texts = ["plain", "a\tb", 'q"x', "back\\slash\\n", "\x01\x7f\x1b", "", "\u00e9:\u00fc", "a\rb\nc"]
    t = TableFrame.from_rows(spark, ["k:1", "v"], [[x, str(i)] for i, x in enumerate(texts)])
    assert list(lines(t, "ltsv")) == [f.ltsv_line({"k:1": x, "v": str(i)}) for i, x in enumerate(texts)]
    assert rows(read(spark, put(tmp_path / "a.ltsv", "".join(lines(t, "ltsv"))))) == [(x, str(i)) for i, x in enumerate(texts)]


@pytest.mark.parametrize("text", ["plain", "a\tb", 'q"x', "back\\slash", "\x01\x7f", ""])
def test_ltsv_round_trip(text):
    assert f.ltsv_cells(f.ltsv_line({"k:1": text, "z": "1"})) == {"k:1": text, "z": "1"}


def test_pnm(spark, tmp_path):
    got = f.pnm_rows(b"P2\n# note\n2 1\n4\n1 4\n")
    assert got[4] == ("meta", None, None, "comment", "note") and [r[4] for r in got[5:]] == [0.25, 1.0]
    assert [r[4] for r in f.pnm_rows(b"P4 3 1\n\xa0")[4:]] == [0, 1, 0]
    with pytest.raises(ValueError):
        f.pnm_rows(b"P5 2 2 255\n\x00")
    assert read(spark, put(tmp_path / "x.pgm", b"P5 1 1 255\n\xff")).df.count() == 5


@pytest.mark.parametrize("image", [
    b"P1\n3 2\n1 0 1\n0 1 0\n", b"P2\n# note\n2 1\n4\n1 4\n", b"P3\n1 1\n255\n1 2 3\n",
    b"P4\n3 1\n\xa0", b"P5\n2 1\n255\n\x00\x80", b"P6\n1 2\n65535\n" + bytes(range(12)),
])
def test_pnm_round_trip(spark, tmp_path, image):
    path = put(tmp_path / "x.pnm", image)
    assert to_pnm(read(spark, path)) == image
    write(read(spark, path), f"pnm:{tmp_path}/y.pnm")
    assert (tmp_path / "y.pnm").read_bytes() == image


def test_pnm_from_pixels(spark):
    def image(*pixels):
        return to_pnm(TableFrame.from_rows(spark, ["type", "x", "y", "component", "value"], [["pixel", *p] for p in pixels]))

    assert image(["0", "0", "V", "7"], ["1", "0", "V", "-1"]) == b"P4\n2 1\n\x40"
    assert image(["0", "0", "V", "0.2"]) == b"P5\n1 1\n255\n\x33"
    assert image(["0", "0", "G", "0.1"]) == b"P6\n1 1\n65535\n\0\0\x19\x9a\0\0"
    for bad in (["0", "0", "K", "1"], ["-1", "0", "V", "1"], ["0", "0", "V", "x"]):
        with pytest.raises(ValueError):
            image(bad)


def test_pp(spark):
    t = TableFrame.from_rows(spark, ["a", "b"], [["1", 'q"\n#{'], [None, "x"], ["y" * 50, "z" * 30]])
    assert "".join(to_pp(t)) == '{"a"=>"1", "b"=>"q\\"\\n\\#{"}\n{"b"=>"x"}\n{"a"=>"%s",\n "b"=>"%s"}\n' % ("y" * 50, "z" * 30)


def test_write_leaves_equal_file(spark, tmp_path):
    t = TableFrame.from_rows(spark, ["a"], [["1"]])
    path = tmp_path / "o.csv"
    write(t, str(path))
    before = path.stat().st_mtime_ns
    write(t, str(path))
    assert path.read_text() == "a\n1\n" and path.stat().st_mtime_ns == before


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("x/" + "long" * 40)
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
        link = tarfile.TarInfo("x/link")
        link.type, link.linkname, link.mtime = tarfile.LNKTYPE, "x/y", 3
        tar.addfile(link)
    t = list_tar(spark, str(tmp_path / "a.tar.gz"), digests=["md5", "sha1"])
    assert t.fields[-2:] == ("md5", "sha1")
    r, other = t.ordered().collect()
    assert (r["size"], r["md5"], r["mtime"]) == ("3", "900150983cd24fb0d6963f7d28e17f72", "1970-01-01T00:00:00Z") and r["path"].startswith("x/long")
    assert (other["filemode"], other["linkname"], other["md5"][:6]) == ("hrw-r--r--", "x/y", "d41d8c")
    full = list_tar(spark, str(tmp_path / "a.tar.gz"), long=True)
    assert full.fields[10:12] == ("atime", "ctime") and full.fields[-5:] == ("size_in_tar", "tar_typeflag", "tar_magic", "tar_version", "tar_chksum")
    r, other = full.ordered().collect()
    assert (other["size_in_tar"], other["tar_typeflag"], other["mtime"], other["atime"]) == ("512", "1", "1970-01-01T00:00:03.000000000Z", None)
    assert int(r["size_in_tar"]) > 1024 and int(r["tar_chksum"]) > 0
    with pytest.raises(ValueError):
        list_tar(spark, "x", digests=["crc"])


def test_directory_listing(spark, tmp_path):
    for name in ("a10", "a9", ".dot", "sub/b", "sub/.c"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("xyz")
    (tmp_path / "link").symlink_to("a9")
    top = str(tmp_path)

    def names(**how):
        return [r["filename"].removeprefix(top + "/") for r in list_dir(spark, top, **how).ordered().collect()]

    assert names() == ["a9", "a10", "link", "sub"]
    assert names(hidden="all") == [".", "..", ".dot", "a9", "a10", "link", "sub"] and names(hidden="almost")[0] == ".dot"
    assert names(recursive=True, hidden="almost") == [".dot", "a9", "a10", "link", "sub", "sub/.c", "sub/b"]
    long = {r["filename"].removeprefix(top + "/"): r for r in list_dir(spark, top, level=1).ordered().collect()}
    assert (long["a9"]["size"], long["a9"]["filemode"][0], long["link"]["symlink"], long["sub"]["filemode"][0]) == ("3", "-", "a9", "d")
    assert long["a9"]["user"] and long["a9"]["mtime"].endswith("Z")
    full = list_dir(spark, top, level=2)
    assert len(full.fields) == 18 and full.ordered().first()["mode"].startswith("0100") and len(full.ordered().first()["mtime"]) == 30
    with pytest.warns(UserWarning):
        assert list_dir(spark, f"{top}/none").df.count() == 0
    assert [r[0] for r in list_dir(spark, f"{top}/a9").ordered().collect()] == [f"{top}/a9"]


def test_git_log(spark, tmp_path):
    def git(*args):
        who = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "GIT_AUTHOR_DATE": "2020-01-02T03:04:05+0100", "GIT_COMMITTER_DATE": "2020-01-02T03:04:05+0000"}
        subprocess.run(["git", *args], cwd=tmp_path, check=True, capture_output=True, env={"PATH": os.environ["PATH"], "HOME": str(tmp_path), **who})

    git("init", "-q", "-b", "main")
    (tmp_path / "one").write_text("1\n2\n")
    git("add", ".")
    git("commit", "-q", "-m", "first")
    (tmp_path / 'odd "\t\u00e9').write_bytes(b"\0\1")
    (tmp_path / "one").write_text("1\n")
    git("add", ".")
    git("commit", "-q", "-m", "second\n\nwith a body")
    t = git_log(spark, str(tmp_path))
    assert len(t.fields) == 18 and t.fields[-1] == "files"
    second, first = t.ordered().collect()
    assert (second["subject"], second["body"], first["body"]) == ("second", "with a body\n", "") and second["raw-body"].startswith("second\n\nwith")
    assert second["parents"] == f"parent\n{first['commit']}\n" and first["parents"] == "parent\n"
    assert (first["author-date"], first["author-name"], first["committer-email"]) == ("2020-01-02T03:04:05+0100", "A", "c@x")
    assert "refs/heads/main" in second["ref-names"]
    files = unnest(cut(t, ["subject", "files"]), "files").ordered().collect()
    assert [(r["subject"], r["add"], r["del"], r["status"], r["filename"]) for r in files] == [
        ("second", None, None, "A", 'odd "\t\u00e9'), ("second", "0", "1", "M", "one"), ("first", "2", "0", "A", "one")]


def test_svn_log(spark, tmp_path):
    log = """<?xml version="1.0"?>
<log>
<logentry revision="2"><author>me</author><date>2020-01-02T03:04:05.000000Z</date>
<paths><path kind="file" action="M">/a</path><path kind="file" action="A">/b</path></paths><msg>two</msg></logentry>
<logentry revision="1"><msg></msg></logentry>
</log>
"""
    t = svn_log(spark, put(tmp_path / "log.xml", log))
    assert rows(t) == [
        ("2", "me", "2020-01-02T03:04:05.000000Z", "two", "file", "M", "/a"), ("2", "me", "2020-01-02T03:04:05.000000Z", "two", "file", "A", "/b"),
        ("1", "(no author)", "(no date)", "", None, None, None)]
    plain = put(tmp_path / "plain.xml", "<log><logentry revision='3'><author>x</author><date>d</date><msg>m</msg></logentry></log>")
    assert svn_log(spark, plain).fields == ("rev", "author", "date", "msg")


def test_yaml(spark):
    t = TableFrame.from_rows(spark, ["a", "b c"], [["1", None], ['q"', "x\ny"]])
    assert "".join(to_yaml(t)) == '---\n- "a": "1"\n  "b c": null\n- "a": "q\\""\n  "b c": "x\\ny"\n'


def test_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<worksheet {main}><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t><t>y</t></is></c></row>
<row r="3"><c r="A3"><v>1.5</v></c><c t="b"><v>1</v></c><c r="C3"/></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>"""
    parts = {
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><r><t>he</t></r><r><t>ad</t></r></si></sst>", "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": f"<worksheet {main}/>",
    }
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    got = workbook(spark, f"{tmp_path}/b.xlsx").orderBy("at", "row").collect()
    assert [(r["sheet"], r["row"], r["cells"]) for r in got] == [("One", 0, ["head", "head", "xy"]), ("One", 1, ["head", "head"]), ("One", 2, ["1.5", "true", None])]
    assert workbook(spark, f"{tmp_path}/b.xlsx", "topleft").orderBy("row").first()["cells"] == ["head", None, "xy"]
    with pytest.raises(ValueError):
        workbook(spark, "x", "other")


def test_profile(spark):
    t = TableFrame.from_rows(spark, ["n", "t", "c", "e"], [["1", "2020-01-02", "a", None], [" 2.5 ", "2020-01-02T03:04:05Z", "1", ""], [None, "2019-12", "a", None]])
    got = {r["field"]: r for r in profile(t).collect()}
    assert [got[f]["kind"] for f in "ntce"] == ["numeric", "time", "categorical", ""]
    assert (got["n"]["low"], got["n"]["high"], got["n"]["filled"]) == ("1.0", "2.5", 2) and (got["t"]["low"], got["t"]["high"]) == ("2019-12", "2020-01-02T03:04:05Z")
    assert (got["c"]["distinct"], got["c"]["numbers"], got["c"]["low"]) == (2, 1, None)
