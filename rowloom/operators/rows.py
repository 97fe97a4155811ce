"""Row numbering and control breaks without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.frame import POS, TableFrame
from rowloom.workspace import written

#: Rows of one window partition when a global order is cut into blocks.
BLOCK_ROWS = 100_000
ROW = "__row"


def numbered(table: TableFrame) -> DataFrame:
    """The rows with ``__row``, 0, 1, 2, ... in the table's order.

    Rows are range-partitioned by the ordinal, once, and written with the number of their
    partition and their place in it; a row's number is that place plus the rows of the
    partitions before. Nothing is evaluated a second time: range bounds come from a sample, so a
    second evaluation could deal the rows otherwise. No task sees more than its range.
    """
    ranged = table.df.repartitionByRange(POS).sortWithinPartitions(POS)
    placed = written(
        ranged.withColumn("__part", F.spark_partition_id()).withColumn("__in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered"
    )
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(ROW, F.col("__in") + F.col("__start")).drop("__part", "__in", "__start")


def with_following(df: DataFrame, n: int, columns: dict[str, Column]) -> DataFrame:
    """``columns`` evaluated over a window that sees the n - 1 rows that follow; needs __row.

    Each row stands in its block, and the first rows of a block in those before that reach them.
    """
    home = F.floor(F.col(ROW) / BLOCK_ROWS)
    reach = F.floor((F.col(ROW) - (n - 1)) / BLOCK_ROWS)  # the first block that sees this row
    out = df.withColumn("__home", home).withColumn("__block", F.explode(F.sequence(F.greatest(reach, F.lit(0)), home)))
    along = Window.partitionBy("__block").orderBy(ROW)
    return out.select("*", *[c.over(along).alias(k) for k, c in columns.items()]).where("__home = __block").drop("__home", "__block")


def islands(table: TableFrame, *keys: Column) -> DataFrame:
    """Numbered rows with ``__island1`` .. one for each key: runs of rows with equal keys,
    numbered from 1; a run also ends where a run of an earlier key ends.

    One exchange by block serves all windows: each block sees the last row of the one before, counts
    the runs that begin in it, and adds those of the blocks before (a row a block).
    """
    df = numbered(table)
    for i, k in enumerate(keys):
        df = df.withColumn(f"__key{i}", k)
    home = F.floor(F.col(ROW) / BLOCK_ROWS)
    also = F.when(F.col(ROW) % BLOCK_ROWS == BLOCK_ROWS - 1, F.array(home, home + 1)).otherwise(F.array(home))
    df = df.withColumn("__home", home).withColumn("__block", F.explode(also))
    along = Window.partitionBy("__block").orderBy(ROW)
    each = range(len(keys))

    def begins(i: int) -> Column:
        own = F.struct(*[F.col(f"__key{j}") for j in range(i + 1)])
        return (F.col("__home") == F.col("__block")) & ((F.col(ROW) == 0) | ~F.lag(own).over(along).eqNullSafe(own))

    df = df.select("*", *[begins(i).cast("long").alias(f"__new{i}") for i in each])
    df = df.select("*", *[F.sum(f"__new{i}").over(along).alias(f"__in{i}") for i in each]).where("__home = __block")
    sums = df.groupBy("__block").agg(*[F.sum(f"__new{i}").alias(f"__s{i}") for i in each])
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__block", *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__o{i}") for i in each])
    df = df.join(sums, "__block")
    df = df.select("*", *[(F.col(f"__in{i}") + F.col(f"__o{i}")).alias(f"__island{i + 1}") for i in each])
    return df.drop("__block", "__home", *[f"__{x}{i}" for x in ("key", "new", "in", "o") for i in each])
