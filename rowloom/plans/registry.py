"""All queries of the table verbs by name, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.frame import TableFrame, field
from rowloom.functions.aggregates import register
from rowloom.operators import columns as C
from rowloom.operators import groups as G
from rowloom.operators import joins as J
from rowloom.operators import order as O
from rowloom.operators import reshape as R
from rowloom.operators.gridsearch import grid_match
from rowloom.operators.rows import ROW, numbered
from rowloom.sources.readers import read
from rowloom.sources.writers import write_folder
from rowloom.workspace import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its name, with the SQL of the same rows."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str, *order: str) -> TableFrame:
    return TableFrame.of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order or None)


def _renamed(t: TableFrame, **names: str) -> TableFrame:
    return C.rename(C.cut(t, list(names)), list(names.items()))


def _money(c) -> F.Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


# --- columns and rows -------------------------------------------------------------------------


@query("SELECT c_name, c_custkey, CAST(NULL AS VARCHAR) AS nothing FROM customer")
def cut_fields(spark, d):
    return C.cut(_table(spark, d, "customer", "c_custkey"), ["c_name", "c_custkey", "nothing"]).result()


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def cut_invert(spark, d):
    return C.cut(_table(spark, d, "customer", "c_custkey"), ["c_name", "c_acctbal"], invert=True).result()


@query("SELECT p_partkey AS p_name, p_name AS p_partkey, p_brand AS brand FROM part")
def rename_swap(spark, d):
    t = C.cut(_table(spark, d, "part", "p_partkey"), ["p_partkey", "p_name", "p_brand"])
    return C.rename(t, [("p_partkey", "p_name"), ("p_name", "p_partkey"), ("p_brand", "brand")]).result()


@query("SELECT 'x' AS tag, o_orderkey, o_orderstatus FROM orders")
def newfield_constant(spark, d):
    return C.newfield(C.cut(_table(spark, d, "orders", "o_orderkey"), ["o_orderkey", "o_orderstatus"]), "tag", "x").result()


@query("SELECT p_size * 2 AS twice, p_partkey, p_size FROM part")
def newfield_expr(spark, d):
    t = C.cut(_table(spark, d, "part", "p_partkey"), ["p_partkey", "p_size"])
    return C.newfield(t, "twice", expr="p_size * 2").result()


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(CAST(p_partkey AS VARCHAR), '11') OR regexp_matches(p_name, '11') OR regexp_matches(p_brand, '11')")
def search_any(spark, d):
    return C.search(C.cut(_table(spark, d, "part", "p_partkey"), ["p_partkey", "p_name", "p_brand"]), "11").result()


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
def search_field(spark, d):
    return C.search(C.cut(_table(spark, d, "part", "p_partkey"), ["p_partkey", "p_name"]), "^[a-m].*e", "p_name").result()


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT regexp_matches(o_orderpriority, 'URGENT|HIGH')")
def search_invert(spark, d):
    return C.search(C.cut(_table(spark, d, "orders", "o_orderkey"), ["o_orderkey", "o_orderpriority"]), "URGENT|HIGH", "o_orderpriority", invert=True).result()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
def search_expr(spark, d):
    return C.cut(C.search(_table(spark, d, "orders", "o_orderkey"), expr="o_totalprice > 200000 and o_orderstatus <> 'F'"), ["o_orderkey", "o_totalprice"]).result()


@query("SELECT regexp_replace(CAST(p_partkey AS VARCHAR), '([aeiou1])', '<\\1>', 'g') AS p_partkey, regexp_replace(p_name, '([aeiou1])', '<\\1>', 'g') AS p_name FROM part")
def gsub_all(spark, d):
    return C.gsub(C.cut(_table(spark, d, "part", "p_partkey"), ["p_partkey", "p_name"]), "([aeiou1])", r"<\1>").result()


@query("SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '$', 'g') AS p_brand FROM part")
def gsub_field(spark, d):
    return C.gsub(C.cut(_table(spark, d, "part", "p_partkey"), ["p_partkey", "p_brand"]), "[0-9]+", "$", "p_brand").result()


@query("SELECT c_custkey, c_name AS name, c_mktsegment, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, s_name, NULL, s_suppkey FROM supplier")
def cat_union(spark, d):
    a, b = _renamed(_table(spark, d, "customer", "c_custkey"), c_custkey="c_custkey", c_name="name", c_mktsegment="c_mktsegment"), _renamed(_table(spark, d, "supplier", "s_suppkey"), s_suppkey="s_suppkey", s_name="name")
    return C.cat([a, b]).result()


@query("SELECT 'c' AS filename, c_name AS name FROM customer UNION ALL SELECT 's', s_name FROM supplier")
def cat_filename(spark, d):
    a, b = _renamed(_table(spark, d, "customer", "c_custkey"), c_name="name"), _renamed(_table(spark, d, "supplier", "s_suppkey"), s_name="name")
    return C.cat([a, b], ["c", "s"]).result()


# --- order ------------------------------------------------------------------------------------

_KEY = (
    "CASE WHEN {0} IS NULL THEN [] WHEN regexp_full_match({0}, '\\s*-?[0-9]+(\\.[0-9]+)?([eE][-+]?[0-9]+)?\\s*') "
    "THEN [{{'t': 0, 'd': try_cast(trim({0}) AS DOUBLE), 's': ''}}] ELSE list_transform(regexp_extract_all({0}, '[0-9]+|[^0-9]+'), "
    "lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN {{'t': 0, 'd': try_cast(x AS DOUBLE), 's': ''}} ELSE {{'t': 1, 'd': 0.0::DOUBLE, 's': x}} END) END"
)


@query(f"SELECT c_name, c_custkey, row_number() OVER (ORDER BY {_KEY.format('c_name')}, c_custkey) AS rank FROM customer")
def sort_natural(spark, d):
    t = C.cut(_table(spark, d, "customer", "c_custkey"), ["c_name", "c_custkey"])
    return O.ranked(t, ["c_name"])


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY 1")
def sort_unique(spark, d):
    return O.sort_unique(_table(spark, d, "orders", "o_orderkey"), ["o_orderpriority"], [("count", "n"), ("min(o_totalprice)", "least")])


@query(f"SELECT p_name, p_brand, p_partkey, row_number() OVER (ORDER BY {_KEY.format('p_brand')}, {_KEY.format('p_name')}, p_partkey) AS rank FROM part")
def sort_natural_two(spark, d):
    return O.ranked(C.cut(_table(spark, d, "part", "p_partkey"), ["p_name", "p_brand", "p_partkey"]), ["p_brand", "p_name"])


@query("SELECT n_name, n_regionkey FROM nation WHERE n_nationkey BETWEEN 2 AND 6")
def crop_range(spark, d):
    t = _table(spark, d, "nation", "n_nationkey")
    grid = t.df.select(F.col("n_nationkey").cast("long").alias("row"), F.array(*[field(f).cast("string") for f in t.fields]).alias("cells"))
    out = O.crop(grid, "B3:C7")
    return out.select(F.col("cells")[0].alias("n_name"), F.col("cells")[1].cast("int").alias("n_regionkey"))


@query("""SELECT * FROM (SELECT o_orderkey AS o_orderkey_1, lead(o_orderkey) OVER w AS o_orderkey_2, lead(o_orderkey, 2) OVER w AS o_orderkey_3,
  o_orderstatus AS o_orderstatus_1, lead(o_orderstatus) OVER w AS o_orderstatus_2, lead(o_orderstatus, 2) OVER w AS o_orderstatus_3 FROM orders WINDOW w AS (ORDER BY o_orderkey)) WHERE o_orderkey_3 IS NOT NULL""")
def consecutive_3(spark, d):
    return O.consecutive(C.cut(_table(spark, d, "orders", "o_orderkey"), ["o_orderkey", "o_orderstatus"]), 3).result()


@query("""SELECT row_number() OVER w - 1 AS row, l_orderkey, l_linenumber, l_returnflag, CAST(sum(n1) OVER w AS BIGINT) AS run1, CAST(sum(n2) OVER w AS BIGINT) AS run2 FROM (
  SELECT *, CASE WHEN l_orderkey IS DISTINCT FROM lag(l_orderkey) OVER o THEN 1 ELSE 0 END AS n1,
    CASE WHEN l_orderkey IS DISTINCT FROM lag(l_orderkey) OVER o OR l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER o THEN 1 ELSE 0 END AS n2
  FROM lineitem WINDOW o AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)) WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)""")
def nested_breaks(spark, d):
    t = _table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return O.control_break(C.cut(t, ["l_orderkey", "l_linenumber", "l_returnflag"]), "l_orderkey", "l_returnflag")


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS row, p_name, p_brand FROM part")
def crop_blank_margins(spark, d):
    """Blank margins about the names and brands of all parts, and blank rows before them."""
    rows = numbered(_table(spark, d, "part", "p_partkey"))
    grid = rows.select((F.col(ROW) + 2).alias("row"), F.array(F.lit(None), F.lit(""), F.col("p_name"), F.col("p_brand"), F.lit("")).alias("cells"))
    blank = spark.createDataFrame([(0, []), (1, ["", None])], "row long, cells array<string>")
    return O.crop(blank.unionByName(grid)).select("row", F.col("cells")[0].alias("p_name"), F.col("cells")[1].alias("p_brand"))


@query("""SELECT event_id - first AS row, event_id, event_type, CAST(sum(new) OVER (ORDER BY event_id) AS BIGINT) AS run1 FROM (
  SELECT event_id, event_type, min(event_id) OVER () AS first, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS new FROM events)""")
def control_break(spark, d):
    return O.control_break(C.cut(_table(spark, d, "events", "event_id"), ["event_id", "event_type"]), "event_type")


# --- groups -----------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS price,
  min(l_quantity) AS low, max(l_quantity) AS high, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1, 2""")
def group_multi(spark, d):
    t = _table(spark, d, "lineitem")
    t = t.having(t.df.withColumn("l_extendedprice", _money("l_extendedprice")))
    out = G.group(t, ["l_returnflag", "l_linestatus"], [("count", "n"), ("sum(l_extendedprice)", "price"), ("min(l_quantity)", "low"), ("max(l_quantity)", "high"), ("sum(l_linenumber)", "lines")])
    return out.result().withColumn("price", F.col("price").cast("decimal(38,2)"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def group_distinct(spark, d):
    return G.group(_table(spark, d, "orders", "o_orderkey"), ["o_orderstatus", "o_orderpriority"]).result()


@query("SELECT c_mktsegment, CAST(sum(c_nationkey) AS DOUBLE) / count(*) AS mean FROM customer GROUP BY 1")
def group_avg(spark, d):
    return G.group(_table(spark, d, "customer", "c_custkey"), ["c_mktsegment"], [("avg(c_nationkey)", "mean")]).result()


@query(f"""SELECT p_brand, arg_min(p_name, (k, p_partkey)) AS low, arg_max(p_name, (k, -p_partkey)) AS high FROM (SELECT *, {_KEY.format('p_name')} AS k FROM part) GROUP BY 1""")
def group_minmax_text(spark, d):
    return G.group(_table(spark, d, "part", "p_partkey"), ["p_brand"], [("min(p_name)", "low"), ("max(p_name)", "high")]).result()


@query("""SELECT l_returnflag, CAST(sum(l_linenumber) AS VARCHAR) AS whole,
  CASE WHEN bool_or(l_linenumber = 7) THEN CAST(CAST(sum(l_linenumber + CASE WHEN l_linenumber = 7 THEN 0.5 ELSE 0 END) AS DOUBLE) AS VARCHAR) ELSE CAST(sum(l_linenumber) AS VARCHAR) END AS part FROM lineitem GROUP BY 1""")
def group_sum_text(spark, d):
    """Sums of text cells, as those of text files: integers unless a cell has a fraction."""
    text = F.col("l_linenumber").cast("string")
    df = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", text.alias("whole"), F.when(text == "7", "7.5").otherwise(text).alias("part"))
    return G.group(TableFrame.of(df), ["l_returnflag"], [("sum(whole)", "whole"), ("sum(part)", "part")]).result()


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN '0' ELSE '' END AS k, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def group_equal_keys(spark, d):
    """Keys that differ as text and are equal naturally: 0, 00 and 0.0 are one, null and '' another; the first row's text stands."""
    key = F.when(F.col("o_orderkey") % 3 == 0, F.element_at(F.array(F.lit("0"), F.lit("00"), F.lit("0.0")), (F.col("o_orderkey") % 2 + 1).cast("int"))).when(F.col("o_orderkey") % 3 == 1, "")
    df = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", key.alias("k"))
    out = G.group(TableFrame.of(df, ["o_orderkey"]), ["k"], [("count", "n"), ("sum(o_orderkey)", "keys")]).result()
    return out.withColumn("k", F.when(F.col("k").rlike("^0"), "0").otherwise(""))


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1""")
def group_values(spark, d):
    return G.group(_table(spark, d, "orders", "o_orderkey"), ["o_custkey"], [("values(o_orderkey)", "keys")]).result()


@query("SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def group_user_aggregate(spark, d):
    register("spread", lambda cell, pos: F.max(cell) - F.min(cell))
    return G.group(_table(spark, d, "orders", "o_orderkey"), ["o_custkey"], [("spread(o_totalprice)", "spread")]).result()


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), '|') AS keys FROM orders GROUP BY 1")
def categorize_values(spark, d):
    return G.categorize(_table(spark, d, "orders", "o_orderkey"), "o_custkey", value="o_orderkey").select("o_custkey", F.array_join("rows", "|").alias("keys"))


@query("SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def categorize_fold(spark, d):
    return G.categorize(_table(spark, d, "orders", "o_orderkey"), "o_custkey", value="o_orderstatus", zero=F.lit(""), step=lambda acc, x: F.concat(acc, x))


@query("SELECT c_custkey, c_name FROM customer")
def unique_categorize(spark, d):
    return G.unique_categorize(_table(spark, d, "customer", "c_custkey"), "c_custkey", value="c_name")


@query("""SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY k) AS statuses FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1""")
def group_uniquevalues(spark, d):
    return G.group(_table(spark, d, "orders", "o_orderkey"), ["o_custkey"], [("uniquevalues(o_orderstatus)", "statuses")]).result()


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS head, arg_max(o_orderstatus, o_orderkey) AS tail,
  array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey)[1:2], '|') AS head2, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey)[-2:], '|') AS tail2 FROM orders GROUP BY 1""")
def group_first_last(spark, d):
    out = G.group(_table(spark, d, "orders", "o_orderkey"), ["o_custkey"], [("first(o_orderstatus)", "head"), ("last(o_orderstatus)", "tail"), ("firstn(2,o_orderkey)", "h"), ("lastn(2,o_orderkey)", "t")])
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(n) for c, n in (("h", "head2"), ("t", "tail2"))]
    return out.result().select("o_custkey", "head", "tail", *joined)


_CROSS = ", ".join(f"nullif(count(*) FILTER (o_orderpriority = '{p}'), 0) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))


@query(f"SELECT o_orderstatus, {_CROSS} FROM orders GROUP BY 1")
def cross_count(spark, d):
    out = G.cross(_table(spark, d, "orders", "o_orderkey"), ["o_orderstatus"], "o_orderpriority")
    return out.result()


_CROSS2 = ", ".join(
    f"nullif(count(*) FILTER (l_returnflag = '{f}' AND l_linenumber = {n}), 0) AS \"{f}.{n}.n\", CAST(sum(l_partkey) FILTER (l_returnflag = '{f}' AND l_linenumber = {n}) AS BIGINT) AS \"{f}.{n}.parts\""
    for f in "ANR" for n in range(1, 8)
)


@query(f"SELECT l_linestatus, {_CROSS2} FROM lineitem GROUP BY 1")
def cross_two_keys(spark, d):
    return G.cross(_table(spark, d, "lineitem"), ["l_linestatus"], ["l_returnflag", "l_linenumber"], [("count", "n"), ("sum(l_partkey)", "parts")]).result()


@query("""SELECT 0 AS row, 'o_orderpriority' AS "1", '1-URGENT' AS "2", '2-HIGH' AS "3", '3-MEDIUM' AS "4", '4-NOT SPECIFIED' AS "5", '5-LOW' AS "6" UNION ALL SELECT 1, 'o_orderstatus', 'count', 'count', 'count', 'count', 'count'
  UNION ALL SELECT 1 + row_number() OVER (ORDER BY s), s, CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(e AS VARCHAR), CAST(f AS VARCHAR) FROM (
  SELECT o_orderstatus AS s, nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS a, nullif(count(*) FILTER (o_orderpriority = '2-HIGH'), 0) AS b,
    nullif(count(*) FILTER (o_orderpriority = '3-MEDIUM'), 0) AS c, nullif(count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED'), 0) AS e, nullif(count(*) FILTER (o_orderpriority = '5-LOW'), 0) AS f FROM orders GROUP BY 1)""")
def cross_rows(spark, d):
    return G.cross_rows(_table(spark, d, "orders", "o_orderkey"), ["o_orderstatus"], "o_orderpriority")


@query("SELECT l_returnflag AS flag, l_linenumber AS line, count(*) AS count FROM lineitem GROUP BY 1, 2")
def category_count(spark, d):
    return G.category_count(_renamed(_table(spark, d, "lineitem"), l_returnflag="flag", l_linenumber="line"), "flag", "line")


# --- joins ------------------------------------------------------------------------------------


def _people(spark, d):
    a = _renamed(_table(spark, d, "customer", "c_custkey"), c_nationkey="key", c_name="customer")
    b = _renamed(_table(spark, d, "nation", "n_nationkey"), n_nationkey="key", n_name="nation")
    s = _renamed(_table(spark, d, "supplier", "s_suppkey"), s_nationkey="key", s_name="supplier")
    return a, b, s


def _moved(t: TableFrame) -> TableFrame:
    """Keys that in part meet no partner."""
    return t.having(t.df.withColumn("key", F.col("key") + 5))


@query("SELECT c_nationkey AS key, c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def natjoin_inner(spark, d):
    a, b, _ = _people(spark, d)
    return J.natjoin(a, b).result()


@query("SELECT n_nationkey AS key, n_name AS nation, s_name AS supplier FROM nation LEFT JOIN supplier ON s_nationkey + 5 = n_nationkey")
def natjoin_left(spark, d):
    _, b, s = _people(spark, d)
    return J.natjoin(b, _moved(s), left=True).result()


@query("SELECT n_nationkey AS key, s_name AS supplier, n_name AS nation FROM supplier RIGHT JOIN nation ON s_nationkey + 5 = n_nationkey")
def natjoin_right(spark, d):
    _, b, s = _people(spark, d)
    return J.natjoin(_moved(s), b, right=True).result()


@query("SELECT coalesce(n_nationkey, s_nationkey + 5) AS key, CASE WHEN n_nationkey IS NULL THEN '-' ELSE n_name END AS nation, CASE WHEN s_nationkey IS NULL THEN '-' ELSE s_name END AS supplier FROM nation FULL JOIN supplier ON s_nationkey + 5 = n_nationkey")
def natjoin_missing(spark, d):
    _, b, s = _people(spark, d)
    return J.join([b, _moved(s)], missing="-").result()


@query("SELECT coalesce(n_nationkey, s_nationkey + 5) AS key, n_name AS nation, s_name AS supplier FROM nation FULL JOIN supplier ON s_nationkey + 5 = n_nationkey")
def natjoin_outer(spark, d):
    _, b, s = _people(spark, d)
    return J.natjoin_outer(b, _moved(s)).result()


@query("""SELECT coalesce(k, s) AS key, coalesce(c, 0) AS customers, coalesce(n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1)
  FULL JOIN (SELECT s_nationkey + 5 AS s, count(*) AS n FROM supplier GROUP BY 1) ON k = s""")
def merge_sorted(spark, d):
    a, _, s = _people(spark, d)
    out = J.merge_sorted([a, _moved(s)], "key")
    return out.select("key", F.size("rows1").cast("long").alias("customers"), F.size("rows2").cast("long").alias("suppliers"))


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def natjoin_product(spark, d):
    return J.natjoin(C.cut(_table(spark, d, "region", "r_regionkey"), ["r_regionkey"]), C.cut(_table(spark, d, "nation", "n_nationkey"), ["n_nationkey"])).result()


@query("SELECT c_nationkey AS key, c_name AS customer, n_name AS nation, s_name AS supplier FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey")
def join_three(spark, d):
    a, b, s = _people(spark, d)
    return J.join([a, b, s]).result()


# --- reshaping --------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS recnum, o_orderkey, unnest(['o_custkey', 'o_orderstatus']) AS variable, unnest([CAST(o_custkey AS VARCHAR), o_orderstatus]) AS value FROM orders")
def melt_recnum(spark, d):
    return R.melt(C.cut(_table(spark, d, "orders", "o_orderkey"), ["o_orderkey", "o_custkey", "o_orderstatus"]), ["o_orderkey"], recnum="recnum").result()


@query("SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS field, unnest([c_name, c_mktsegment]) AS cell FROM customer")
def melt_regexp(spark, d):
    return R.melt(_table(spark, d, "customer", "c_custkey"), ["c_custkey"], fields=["c_name"], regexps=["c_mkt.*"], variable="field", value="cell").result()


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def unmelt_melted(spark, d):
    t = R.melt(C.cut(_table(spark, d, "customer", "c_custkey"), ["c_custkey", "c_name", "c_mktsegment"]), ["c_custkey"])
    return R.unmelt(t, ["c_custkey"], names=["c_name", "c_mktsegment"]).result()


@query("SELECT l_orderkey, 'l_partkey,l_returnflag' || chr(10) || string_agg(l_partkey || ',' || l_returnflag || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY 1")
def nest_csv(spark, d):
    t = C.cut(_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_partkey", "l_returnflag"])
    return R.nest(t, "lines", ["l_partkey", "l_returnflag"]).result()


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def nest_unnest(spark, d):
    t = C.cut(_table(spark, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey", "o_orderstatus"])
    return R.unnest(R.nest(t, "orders", ["o_orderkey", "o_orderstatus"], as_csv=False), "orders").result()


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS x_o_orderkey, o_orderstatus AS x_o_orderstatus FROM orders")
def unnest_csv(spark, d):
    t = C.cut(_table(spark, d, "orders", "o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey", "o_orderstatus"])
    return R.unnest(R.nest(t, "orders", ["o_orderkey", "o_orderstatus"]), "orders", prefix="x_", outer=True).result()


@query("SELECT p_partkey, 'b' || p_brand AS \"the brand\", CAST(p_size AS VARCHAR) AS size FROM part")
def merged_header(spark, d):
    """Two header rows over all parts: neighbouring repeats in a column count once."""
    rows = numbered(_table(spark, d, "part", "p_partkey"))
    body = rows.select((F.col(ROW) + 2).alias("row"), F.array(F.col("p_partkey").cast("string"), F.concat(F.lit("b"), "p_brand"), F.col("p_size").cast("string")).alias("cells"))
    top = spark.createDataFrame([(0, ["p_partkey", "the", "size"]), (1, ["p_partkey", "brand", "size"])], body.schema)
    names, rest = R.mheader(top.unionByName(body), 2)
    return rest.select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)]).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("""SELECT 'orders' AS filename, count(*) AS records, CAST(6 AS BIGINT) AS min_pairs, CAST(6 AS BIGINT) AS max_pairs, CAST(NULL AS BIGINT) AS header_fields, CAST(NULL AS BIGINT) AS min_fields, CAST(NULL AS BIGINT) AS max_fields FROM orders
  UNION ALL SELECT 'part', count(*), 6, 6, NULL, NULL, NULL FROM part""")
def shape(spark, d):
    return R.shape([("orders", _table(spark, d, "orders", "o_orderkey")), ("part", _table(spark, d, "part", "p_partkey"))])


# --- files ------------------------------------------------------------------------------------

_FILE_SQL = "SELECT row_number() OVER (ORDER BY o_orderkey) AS rank, {} AS key, o_orderstatus AS status, o_orderpriority || ', \"' || o_orderstatus || '\"' AS note FROM orders"


def _through(spark: SparkSession, d: str, kind: str) -> TableFrame:
    """All orders written as part files of a format and read again."""
    note = F.concat("o_orderpriority", F.lit(', "'), "o_orderstatus", F.lit('"'))
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), note.alias("note"))
    path = shared_path(spark, kind)
    write_folder(TableFrame.of(df, ["key"]), path, kind)
    return read(spark, f"{kind}:{path}")


def _places(t: TableFrame) -> DataFrame:
    return numbered(t).select((F.col(ROW) + 1).alias("rank"), *[field(f) for f in t.fields])


def _file_query(kind: str, key: str) -> None:
    def run(spark, d):
        return _places(_through(spark, d, kind))

    run.__name__ = f"{kind}_files"
    query(_FILE_SQL.format(key))(run)


for _kind in ("csv", "tsv", "ltsv", "ndjson"):
    _file_query(_kind, "o_orderkey" if _kind == "ndjson" else "CAST(o_orderkey AS VARCHAR)")


@query("""SELECT 'orders' AS filename, count(*) AS records, CAST(3 AS BIGINT) AS min_pairs, CAST(3 AS BIGINT) AS max_pairs, CAST(3 AS BIGINT) AS header_fields, CAST(3 AS BIGINT) AS min_fields, CAST(3 AS BIGINT) AS max_fields FROM orders""")
def shape_of_files(spark, d):
    return R.shape([("orders", _through(spark, d, "csv"))])


# --- grids ------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS grid_id, y, y + 1 AS end_y FROM (SELECT o_custkey, o_orderstatus, row_number() OVER w - 1 AS y, lead(o_orderstatus) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
  WHERE o_orderstatus = 'F' AND next = 'O'""")
def grid_pattern(spark, d):
    """In each customer's column of order states, an F and below it an O."""
    grids = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("grid_id"), F.col("o_orderkey").alias("row"), F.array("o_orderstatus").alias("cells"))
    return grid_match(grids, ("cat", "F", "s", "O")).select("grid_id", "y", "end_y")
