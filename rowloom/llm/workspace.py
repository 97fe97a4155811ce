"""Shared-folder tables that cut lineage, and session helpers used by every operator here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.workspace import let_workers_import, shared_path

#: The columns of :meth:`Workspace.numbered`.
ROW = "row"
DOC = "doc"


class Workspace:
    """Tables of one operator call, written as Parquet under the shared folder.

    A written table survives the loss of any executor, is compressed, and can be dropped as
    soon as nothing reads it any more; what is left goes with ``rowloom.workspace.release()`` or
    when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_path(spark, name)
        let_workers_import(spark)

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.base}/{tag}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def numbered(self, df: DataFrame, tag: str) -> DataFrame:
        """(row, doc): a number of its own for each row, written before use so that it holds, and the
        row itself as a struct, so that its columns may have any names."""
        return self.save(df.select(F.monotonically_increasing_id().alias(ROW), F.struct("*").alias(DOC)), tag)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._delete(f"{self.base}/{tag}")


def texts(rows: DataFrame) -> DataFrame:
    """(row, doc_id, text) of numbered rows."""
    return rows.select(ROW, f"{DOC}.doc_id", f"{DOC}.text")
