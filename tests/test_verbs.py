import pytest
from pyspark.sql import functions as F

from rowloom.frame import TableFrame
from rowloom.functions.natural import number_text
from rowloom.functions.patterns import jvm_pattern
from rowloom.operators import columns as C
from rowloom.operators import groups as G
from rowloom.operators import joins as J
from rowloom.operators import order as O
from rowloom.operators import reshape as R


def table(spark, header, *rows):
    return TableFrame.from_rows(spark, header.split(","), rows)


def cells(t):
    return [tuple(r) for r in (t.ordered() if isinstance(t, TableFrame) else t).collect()]


def test_natural_order(spark):
    t = table(spark, "v", ["b"], ["a10"], ["2e1"], [None], ["a9"], ["-3"], [""], [" 7 "], ["08"], ["+5"])
    assert [v for (v,) in cells(O.sort(t))] == [None, "", "-3", " 7 ", "08", "2e1", "+5", "a9", "a10", "b"]
    assert [v for (v,) in cells(O.sort(t, reverse=True))][:2] == ["b", "a10"]


def test_group_rules(spark):
    t = table(spark, "k,v", ["a", "1"], ["a", None], ["b", None], ["08", "x"], ["8", "y"])
    assert cells(G.group(t, ["k"], [("count", "n"), ("values(v)", "v")])) == [("08", 2, "x,y"), ("a", 2, "1"), ("b", 1, "")]
    n = table(spark, "k,v", ["a", "1"], ["a", "2.5"], ["b", None])
    assert cells(G.group(n, ["k"], ["sum(v)", "avg(v)", "min(v)"])) == [("a", "3.5", 1.75, "1"), ("b", "0", None, None)]
    with pytest.raises(ValueError):
        G.group(t, ["k"], ["median(v)"])


def test_sums_of_text_cells(spark):
    t = table(spark, "k,v", ["a", "1"], ["a", " 2 "], ["b", "9" * 30], ["b", "1"], ["c", "1.0"], ["c", "2"], ["d", "1e3"], ["d", ".5"], ["e", None], ["f", "123456789.25"], ["g", "1e-7"])
    assert dict(cells(G.group(t, ["k"], ["sum(v)"]))) == {
        "a": "3", "b": "1" + "0" * 30, "c": "3.0", "d": "1000.5", "e": "0", "f": "123456789.25", "g": "1.0e-07"}
    with pytest.raises(Exception, match="not a number"):
        cells(G.group(table(spark, "v", [""]), [], ["sum(v)"]))
    texts = {1e7: "10000000.0", 12345678.5: "12345678.5", 1e16: "1.0e+16", 1.5e-5: "1.5e-05", 0.00012: "0.00012", -2.5e10: "-25000000000.0", 3.0: "3.0", 1e120: "1.0e+120"}
    frame = spark.createDataFrame([(x,) for x in texts], "x double")
    assert {r[0]: r[1] for r in frame.select("x", number_text(F.col("x"))).collect()} == texts


def test_groups_of_equal_keys_merge(spark):
    t = table(spark, "k,v", ["08", "b"], ["8", "a"], ["8.0", "c"], ["", "z"], [None, "y"], ["8", None])
    out = cells(G.group(t, ["k"], ["count", "min(v)", "max(v)", "first(v)", "last(v)", "values(v)", "firstn(2,v)", "lastn(2,v)", "uniquevalues(k)"]))
    assert out == [("", 2, "y", "z", "z", "y", "z,y", ["z", "y"], ["z", "y"], ""), ("08", 4, "a", "c", "b", None, "b,a,c", ["b", "a"], ["c", None], "08,8,8.0")]
    assert cells(G.group(t, [], ["count"])) == [(6,)]
    assert cells(G.group(t, ["nothing"], ["count"])) == [(None, 6)]


def test_user_aggregates_and_folds(spark):
    from rowloom.functions import aggregates

    aggregates.register("longest", lambda cell, pos: F.max(F.length(cell)))
    aggregates.register("chained", lambda cell, pos: aggregates.folded(cell, F.lit(""), lambda acc, x: F.concat(acc, F.lit("<"), F.coalesce(x, F.lit("-"))), pos=pos))
    t = table(spark, "k,v", ["8", "aa"], ["08", "b"], ["x", None])
    assert cells(G.group(t, ["k"], ["longest(v)", "chained(v)", "count"])) == [("8", 2, "<aa<b", 2), ("x", None, "<-", 1)]
    assert {"count", "sum", "longest"} <= set(aggregates.names())
    with pytest.raises(ValueError):
        aggregates.register("sum", lambda cell, pos: F.count(cell))
    assert sorted(cells(G.categorize(t, "k", value="v", zero=F.lit(0), step=lambda acc, x: acc + F.coalesce(F.length(x), F.lit(0))))) == [("08", 1), ("8", 2), ("x", 0)]
    other = G.categorize(C.newfield(t, "all", "1"), "all", value="v", compare=lambda a, b: F.coalesce(F.length(a), F.lit(9)) - F.coalesce(F.length(b), F.lit(9)))
    assert cells(other) == [("1", ["b", "aa", None])]
    with pytest.raises(Exception, match="ambiguous key"):
        cells(G.unique_categorize(C.newfield(t, "all", "1"), "all", value="v"))


def test_join_keeps_null_cells(spark):
    a, b = table(spark, "a,b", ["1", None], ["2", "y"]), table(spark, "a,c", ["1", "p"], ["3", "q"])
    assert sorted(cells(J.join([a, b], missing="-").result()), key=str) == [("1", None, "p"), ("2", "y", "-"), ("3", "-", "q")]
    assert len(cells(J.natjoin(C.cut(a, ["b"]), C.cut(b, ["c"])))) == 4


def test_rows_that_meet_many_are_dealt_out(spark):
    def parted(rows, name):
        return TableFrame.of(spark.range(0, rows, 1, 1).select((F.col("id") % 1000).cast("int").alias("k"), F.col("id").alias(name)))

    a, b, c = parted(100_000, "x"), parted(20_000, "y"), parted(1_000, "z")
    for out in (J.natjoin(a, b), J.natjoin(b, a), J.natjoin(a, b, left=True), J.natjoin(b, a, right=True), J.join([a, c, b]), J.join([c, a, b])):
        rows = out.result().groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum(F.col("x") * 20_000 + F.col("y"))).collect()
        assert sum(r[1] for r in rows) == 2_000_000
        assert sum(r[2] for r in rows) == 20_000 * 20 * sum(range(100_000)) + 100 * sum(range(20_000))
        assert max(r[1] for r in rows) < 200_000


def test_join_integer_keys(spark):
    from pyspark.sql import types as T

    def keyed(kind, name, *keys):
        return TableFrame.of(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], T.StructType([T.StructField("k", kind), T.StructField(name, T.LongType())])))

    low, high = -(1 << 31), (1 << 31) - 1
    a = keyed(T.IntegerType(), "x", None, low, -1, 0, high, None)
    for kind, b in ((T.IntegerType(), (high, None, 0, low)), (T.ShortType(), (None, 0, -1)), (T.LongType(), (1 << 40, None, high, 0))):
        b = keyed(kind, "y", *b)
        pairs = [(p.k, p.x, q.y) for p in a.df.collect() for q in b.df.collect() if p.k == q.k]
        assert sorted(cells(J.natjoin(a, b).result()), key=str) == sorted(pairs, key=str)
        assert len(cells(J.natjoin(a, b, left=True).result())) == len(pairs) + 6 - len({x for _, x, _ in pairs})
        assert len(cells(J.natjoin(a, b, right=True).result())) == len(pairs) + b.df.count() - len({y for _, _, y in pairs})


def test_cut_rename_newfield_gsub(spark):
    t = table(spark, "a,b", ["x1", None])
    assert cells(C.rename(t, [("a", "b"), ("b", "a")])) == [("x1", None)]
    assert C.newfield(t, "b", "new").fields == ("b", "a") and cells(C.newfield(t, "b", "new")) == [(None, "x1")]
    assert cells(C.gsub(t, r"(\d)", r"<\1$>")) == [("x<1$>", "")]
    with pytest.raises(ValueError):
        C.rename(t, [("zz", "a")])


def test_patterns(spark):
    def found(pattern, text):
        return spark.createDataFrame([(text,)], "x string").select(F.col("x").rlike(jvm_pattern(pattern))).first()[0]

    assert found("^$", "") and found("^b", "a\nb") and not found("^b", "ab") and not found("^b", "a\rb")
    assert found("a$", "a\nb") and found(r"a\Z", "a\n") and not found(r"a\Z", "a\n\n") and found(r"\h", "x7") and not found(r"[\h]", "xyz")
    assert found("[^a]", "b") and not found("[^a]", "a") and found(r"\^", "^") and found("(?m)a.b", "a\nb") and not found("a.b", "a\nb")


def test_melt_unmelt(spark):
    t = table(spark, "k,x,y", ["1", "a", "b"], ["2", "c", None])
    m = R.melt(t, ["k"], recnum="n")
    assert cells(m) == [(1, "1", "x", "a"), (1, "1", "y", "b"), (2, "2", "x", "c"), (2, "2", "y", None)]
    assert cells(R.unmelt(m, ["k"], recnum="n")) == [("1", "a", "b"), ("2", "c", None)]
    long = table(spark, "k,variable,value", ["1", "x", "a"], ["1", "x", "b"], ["1", "y", "c"])
    assert cells(R.unmelt(long, missing="-")) == [("1", "a", "-"), ("1", "b", "c")]


def test_nest_unnest(spark):
    t = table(spark, "a,b,c", ["1", "x,y", None], ["1", "", "z"], ["2", "p", "q"])
    nested = R.nest(t, "n", ["b", "c"])
    assert cells(nested) == [("1", 'b,c\n"x,y",\n"",z\n'), ("2", "b,c\np,q\n")]
    assert [r[:2] for r in cells(R.unnest(nested, "n"))] == [("1", "x,y"), ("1", ""), ("2", "p")]
    assert cells(R.unnest(table(spark, "a,n", ["1", None]), "n", outer=True, names=["b"])) == [("1", None)]


def test_consecutive_and_breaks(spark, monkeypatch):
    from rowloom.operators import rows

    monkeypatch.setattr(rows, "BLOCK_ROWS", 3)  # blocks smaller than the table
    t = table(spark, "v", *[[str(i // 4)] for i in range(11)])
    assert cells(O.consecutive(t, 3)) == [(str(i // 4), str((i + 1) // 4), str((i + 2) // 4)) for i in range(9)]
    runs = sorted(O.control_break(t, "v").collect())
    assert [r["run1"] for r in runs] == [i // 4 + 1 for i in range(11)]
    assert cells(O.consecutive(table(spark, "v", ["1"]), 2)) == []


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_many_wide_rows(spark, adaptive):
    """Millions of rows over many partitions: sampled range bounds must be drawn once."""
    from rowloom.operators.rows import ROW, numbered

    n = 2_000_000
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        df = spark.range(0, n, 1, 16).select(F.pmod(F.col("id") * 1_000_003, F.lit(n)).alias("id"), F.repeat(F.lit("wide "), 20).alias("text"))
        t = TableFrame.of(df.withColumn("run", F.expr("id div 7")), ["id"])
        rows = numbered(t)
        assert rows.agg(F.count(F.lit(1)), F.count_if(F.col(ROW) != F.col("id")), F.countDistinct(ROW)).first()[:] == (n, 0, n)
        runs = O.control_break(t, "run")
        assert runs.agg(F.count(F.lit(1)), F.count_if(F.col("run1") != F.col("run") + 1)).first()[:] == (n, 0)
        threes = O.consecutive(C.cut(t, ["id"]), 3).result()
        assert threes.agg(F.count(F.lit(1)), F.count_if((F.col("id_2") != F.col("id_1") + 1) | (F.col("id_3") != F.col("id_1") + 2))).first()[:] == (n - 2, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nested_breaks(spark, monkeypatch):
    from rowloom.operators import rows

    monkeypatch.setattr(rows, "BLOCK_ROWS", 2)
    t = table(spark, "a,b", *[[str(i // 6), str(i // 2 % 2)] for i in range(12)], [None, None], [None, None])
    got = O.control_break(t, "a", "b").orderBy("row").collect()
    assert [r["run1"] for r in got] == [1] * 6 + [2] * 6 + [3] * 2
    assert [r["run2"] for r in got] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7]
    assert cells(O.consecutive(table(spark, "v", *[[str(i)] for i in range(9)]), 6)) == [tuple(str(j) for j in range(i, i + 6)) for i in range(4)]


def test_cross_and_crop_and_header(spark):
    t = table(spark, "n,y", ["a", "10"], ["a", "9"], ["b", "9"], ["a", "9"])
    assert G.cross(t, ["n"], "y").fields == ("n", "9", "10")
    w = table(spark, "v,w,a,b,x", ["p", "q", "2", "u", "1"], ["p", "q", "10", "u", "2"], ["p", "r", "2", "t", "4"], ["p", "q", "2", "u", "8"])
    rows = [tuple(r) for r in G.cross_rows(w, ["v", "w"], ["a", "b"], [("count", "n"), "sum(x)"]).orderBy("row").collect()]
    assert rows == [
        (0, None, "a", "2", "2", "2", "2", "10", "10"), (1, None, "b", "t", "t", "u", "u", "u", "u"), (2, "v", "w", "n", "sum(x)", "n", "sum(x)", "n", "sum(x)"),
        (3, "p", "q", None, None, "2", "9", "1", "2"), (4, "p", "r", "1", "4", None, None, None, None)]
    compact = [tuple(r) for r in G.cross_rows(w, ["v"], ["a", "b"], "values(x)", compact=True).orderBy("row").collect()]
    assert compact == [(0, "a", "2", "2", "10"), (1, "v", "t", "u", "u"), (2, "p", "4", "1,8", "2")]
    assert cells(G.cross(t, ["n"], "y")) == [("a", 2, 1), ("b", 1, None)]
    assert sorted(tuple(r) for r in G.cross_rows(t, ["n"], "y").collect()) == [(0, "y", "9", "10"), (1, "n", "count", "count"), (2, "a", "2", "1"), (3, "b", "1", None)]
    grid = spark.createDataFrame([(0, [None, ""]), (1, ["", "a", "b", ""]), (2, [None, "c"]), (3, [""])], "row long, cells array<string>")
    assert sorted((r["row"], r["cells"]) for r in O.crop(grid).collect()) == [(0, ["a", "b"]), (1, ["c"])]
    heads = spark.createDataFrame([(0, ["x", "x", None]), (1, ["a", "b", "c"]), (2, ["1", "2", "3"])], "row long, cells array<string>")
    same = spark.createDataFrame([(i, ["x", "x"]) for i in range(100)], "row long, cells array<string>")
    with pytest.warns(UserWarning):
        assert R.mheader(same)[0] == [] and R.mheader(same)[1].count() == 0
    late = same.unionByName(spark.createDataFrame([(100, ["y", None]), (101, ["x", "z"]), (102, ["1", "2"])], same.schema))
    assert R.mheader(late)[0] == ["x y", "x"]
    assert R.mheader(late, 102)[0] == ["x y x", "x z"] and [r["row"] for r in R.mheader(late, 102)[1].collect()] == [0]
    names, rest = R.mheader(heads)
    assert names == ["x a", "x b", "c"] and [tuple(r) for r in rest.collect()] == [(0, ["1", "2", "3"])]


def test_outer_join_merge_and_unique_sort(spark):
    a, b = table(spark, "k,x", ["10", "p"], ["9", "q"], [None, "n"], ["9", "r"]), table(spark, "k,y", ["9", "s"], ["11", "t"])
    assert sorted(cells(J.natjoin_outer(a, b, missing="-")), key=str) == sorted([("10", "p", "-"), ("9", "q", "s"), ("9", "r", "s"), (None, "n", "-"), ("11", "-", "t")], key=str)
    got = [(r["k"], [x["x"] for x in r["rows1"]], [x["y"] for x in r["rows2"]], len(r["rows3"])) for r in J.merge_sorted([a, b, C.cut(a, ["k"])], "k").collect()]
    assert got == [(None, ["n"], [], 1), ("9", ["q", "r"], ["s"], 2), ("10", ["p"], [], 1), ("11", [], ["t"], 0)]
    assert cells(O.sort_unique(a, ["k"], ["values(x)"])) == [(None, "n"), ("9", "q,r"), ("10", "p")]


def test_sort_by_a_comparator(spark):
    def beats(a, b):
        return len(b["w"] or "") - len(a["w"] or "")

    words = ["aa", "b", None, "cccc", "dd", "e", "f" * 9] * 40
    t = table(spark, "w,n", *[[w, str(i)] for i, w in enumerate(words)])
    want = sorted(range(len(words)), key=lambda i: -len(words[i] or ""))
    assert [(r["w"], int(r["n"])) for r in O.sort_with(t, beats, parts=4).ordered().collect()] == [(words[i], i) for i in want]
    assert O.sort_with(t.having(t.df.limit(0)), beats).df.count() == 0


def test_unmelt_lacking_cells(spark):
    long = table(spark, "k,variable,value", ["1", "x", "a"], ["2", "y", "b"])
    from rowloom.sources.writers import lines

    assert "".join(lines(R.unmelt(long), "csv")) == "k,x,y\n1,a\n2,,b\n"


def test_cat_unites_fields(spark):
    t = C.cat([table(spark, "a,b", ["1", "2"]), table(spark, "b,c", ["3", "4"])], ["p", "q"])
    assert t.fields == ("filename", "a", "b", "c") and cells(t) == [("p", "1", "2", None), ("q", None, "3", "4")]
