import io
import os

import pytest

from rowloom.cli import main


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (["sort", "-f", "b"], "a,b\ny,9\nx,10\nz,b2\n"),
        (["group", "-a", "count,n", "a"], "a,n\nx,1\ny,1\nz,1\n"),
        (["cut", "-v", "a"], "b\n10\n9\nb2\n"),
        (["search", "-f", "b", "-e", "^[0-9]+$"], "a,b\nx,10\ny,9\n"),
        (["crop", "-r", "A2:A3"], "x\ny\n"),
        (["to-tsv"], "a\tb\nx\t10\ny\t9\nz\tb2\n"),
        (["to-json"], '[{\n  "a": "x",\n  "b": "10"\n},\n{\n  "a": "y",\n  "b": "9"\n},\n{\n  "a": "z",\n  "b": "b2"\n}]\n'),
        (["cross", "-a", "count,n", "-a", "values(b)", "a", "b"], "b,9,9,10,10,b2,b2\na,n,values(b),n,values(b),n,values(b)\nx,,,1,10,,\ny,1,9,,,,\nz,,,,,1,b2\n"),
        (["mheader", "-c", "2"], "a x,b 10\ny,9\nz,b2\n"),
    ],
)
def test_verbs(spark, tmp_path, args, want):
    (tmp_path / "t.csv").write_text("a,b\nx,10\ny,9\nz,b2\n")
    assert main([*args, "-o", str(tmp_path / "o.csv"), str(tmp_path / "t.csv")]) == 0
    assert (tmp_path / "o.csv").read_text() == want


def test_several_files_and_help(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    assert main(["cat", "-H", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]) == 0
    assert capsys.readouterr().out == f"filename,a,b\n{tmp_path}/a.csv,1,2\n{tmp_path}/b.csv,4,3\n"
    assert main(["ls", str(tmp_path)]) == 0 and capsys.readouterr().out == f"filename\n{tmp_path}/a.csv\n{tmp_path}/b.csv\n"
    assert main(["help", "-s", "cut"]) == 0 and capsys.readouterr().out == "cut: choose fields\n"
    assert main(["help"]) == 0 and "unmelt" in capsys.readouterr().out
    assert main(["help", "cross"]) == 0 and "--compact" in capsys.readouterr().out
    with pytest.raises(ValueError):
        main(["help", "nothing"])


def test_pager(monkeypatch, tmp_path):
    from rowloom import cli

    class Screen(io.StringIO):
        def isatty(self):
            return True

    monkeypatch.setenv("PAGER", f"cat > {tmp_path}/paged")
    monkeypatch.setattr(cli.shutil, "get_terminal_size", lambda: os.terminal_size((10, 4)))
    small, large = Screen(), Screen()
    cli.show(["1\n", "2\n", "x" * 9 + "\n"], small)
    cli.show(["1\n", "x" * 21 + "\n", "3\n"], large)
    assert small.getvalue() == "1\n2\nxxxxxxxxx\n" and large.getvalue() == ""
    assert (tmp_path / "paged").read_text() == "1\n" + "x" * 21 + "\n3\n"
