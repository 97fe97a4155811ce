"""A table: a DataFrame, its ordered field names, and a row ordinal that keeps the input order.

The ordinal lives in the hidden column ``__pos``. Row order matters to several verbs, and a
DataFrame has none, so every verb that needs order reads the ordinal. Rows of text files may
lack cells that others have; where the hidden column ``__absent`` is there, it lists the fields a
row lacks, which are null but neither a null cell nor an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS = "__pos"
ABSENT = "__absent"
#: The number of cells of a row's line, where it was read from a file with a header line.
WIDTH = "__width"


#: Fields that a table has at most where its header comes from its rows.
HEADER_FIELDS = 10_000


def header(names: DataFrame) -> list:
    """The one column of a small ordered table, as a header; more names than a plan can hold are an error."""
    rows = names.limit(HEADER_FIELDS + 1).collect()
    if len(rows) > HEADER_FIELDS:
        raise ValueError(f"more than {HEADER_FIELDS} fields")
    return [r[0] for r in rows]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(name: str) -> Column:
    return F.col(quoted(name))


@dataclass(frozen=True)
class TableFrame:
    df: DataFrame
    fields: tuple[str, ...]
    #: Cells of the header line that the table was read with, if it was.
    header_width: int | None = None

    @staticmethod
    def of(df: DataFrame, order: Sequence[str | Column] | None = None) -> TableFrame:
        """Wrap a DataFrame. ``order`` names columns whose values give the row order as an
        ordinal, rows with equal ones in scan order (a single integer column is taken as it is
        and should have no equals); without it rows keep scan order."""
        fields = tuple(c for c in df.columns if c not in (POS, ABSENT, WIDTH))
        if order is None:
            return TableFrame(df if POS in df.columns else df.withColumn(POS, F.monotonically_increasing_id()), fields)
        keys = [F.col(c) if isinstance(c, str) else c for c in order]
        pos = keys[0].cast("long") if len(keys) == 1 else F.struct(*keys, F.monotonically_increasing_id().alias("tie"))
        return TableFrame(df.withColumn(POS, pos), fields)

    @staticmethod
    def from_rows(spark: SparkSession, header: Sequence[str], rows: Iterable[Sequence]) -> TableFrame:
        """A table of text cells from a header and value rows; short rows are filled with null."""
        width = len(header)
        data = [(i, *[*row, *[None] * width][:width]) for i, row in enumerate(rows)]
        schema = T.StructType([T.StructField(POS, T.LongType()), *[T.StructField(h, T.StringType()) for h in header]])
        return TableFrame(spark.createDataFrame(data, schema), tuple(header))

    def result(self, pos: bool = False) -> DataFrame:
        """The fields in order, with the ordinal if asked for."""
        return self.df.select(*([F.col(POS)] if pos else []), *[field(f) for f in self.fields])

    def ordered(self) -> DataFrame:
        return self.df.orderBy(POS).select(*[field(f) for f in self.fields])

    @property
    def ragged(self) -> bool:
        return ABSENT in self.df.columns

    def hidden(self) -> list[Column]:
        """The ordinal and, if rows may lack cells, the fields they lack."""
        return [F.col(POS), *([F.col(ABSENT)] if self.ragged else [])]

    def present(self, name: str) -> Column:
        return ~F.array_contains(ABSENT, name) if self.ragged else F.lit(True)

    def having(self, df: DataFrame, fields: Iterable[str] | None = None) -> TableFrame:
        return TableFrame(df, tuple(self.fields if fields is None else fields))

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def write(self, spec: str) -> None:
        """Write one local file in the format that its name tells."""
        from rowloom.sources.writers import write

        write(self, spec)

    def write_folder(self, path: str, kind: str = "csv") -> None:
        """Write a folder of part files, in parallel."""
        from rowloom.sources.writers import write_folder

        write_folder(self, path, kind)

    def lines(self, kind: str) -> Iterable[str]:
        """The lines of csv, tsv, ltsv, json, ndjson, or of csv and tsv without a header (ncsv, ntsv)."""
        from rowloom.sources.writers import lines

        return lines(self, kind)
