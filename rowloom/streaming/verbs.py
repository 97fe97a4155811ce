"""Row-local verbs over Structured Streaming: they are plain projections and filters, so the
batch verbs apply to a streaming DataFrame as they are; grouped counts run in complete mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.frame import POS, TableFrame, field


def streamed(df: DataFrame, *verbs: Callable[[TableFrame], TableFrame]) -> DataFrame:
    """Apply cut, rename, newfield, search, gsub or melt to a stream. Streams have no row order, so the ordinal is null."""
    table = TableFrame(df.withColumn(POS, F.lit(None).cast("long")), tuple(df.columns))
    for verb in verbs:
        table = verb(table)
    return table.result()


def windowed_count(df: DataFrame, time: str, size: str, late: str, *keys: str) -> DataFrame:
    """Rows by event-time window and keys; rows later than ``late`` behind the watermark are dropped by Spark."""
    return df.withWatermark(time, late).groupBy(F.window(time, size), *[field(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
