"""What the fields of a table hold: numbers, times or categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.frame import TableFrame, field
from rowloom.functions.natural import cell_text

# What counts as a number and as a time in a text cell, whole cell.
NUMBER = r"\A\s*-?([0-9]+|([0-9]+\.[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?)\s*\z"
TIME = r"\A\s*-?[0-9]+-[0-9]{2}(-[0-9]{2}([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?)?)?)?\s*\z"


def profile(table: TableFrame) -> DataFrame:
    """For each field: field, kind (numeric, time or categorical; empty without cells), filled, numbers, times, distinct
    (about), low and high (of the numbers, or the times).

    A kind is that of all filled cells. One pass over the table, whose partial aggregates hold a few values a field.
    """
    rows = []
    for name in table.fields:
        text = cell_text(field(name), table.dtype(name))
        filled = F.coalesce(text, F.lit("")) != ""
        number, time = text.rlike(NUMBER), text.rlike(TIME)
        value = F.when(number, F.btrim(text).try_cast("double"))
        when = F.when(time, F.btrim(text))
        numbers, times, some = F.count_if(number), F.count_if(time), F.count_if(filled)
        kind = F.when(some == 0, "").when(numbers == some, "numeric").when(times == some, "time").otherwise("categorical")
        low, high = (F.when(numbers == some, one(value).cast("string")).when(times == some, one(when)) for one in (F.min, F.max))
        rows.append(F.struct(
            F.lit(name).alias("field"), kind.alias("kind"), some.alias("filled"), numbers.alias("numbers"), times.alias("times"),
            F.approx_count_distinct(F.when(filled, text)).alias("distinct"), low.alias("low"), high.alias("high"),
        ))
    return table.df.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
