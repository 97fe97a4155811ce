"""Natural ordering of cells: numbers before text, digits inside text by value, null first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in a text cell, whole cell.
INTEGER = r"\A\s*-?[0-9]+\s*\z"
NUMBER = r"\A\s*-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\s*\z"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def natural_key(cell: Column, dtype: T.DataType) -> Column:
    """A sortable, groupable key of a cell.

    Text: an array of parts, each (0, number) or (1, text); null and '' have no parts and sort
    first. Numeric columns are their own key (null first), so the scan's types keep sorts fast.
    Exact to 20 digits; longer digit runs compare as doubles. Arrays, maps and structs are refused.
    """
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BooleanType)):
        raise TypeError(f"cells of type {dtype.simpleString()} have no order")
    if not isinstance(dtype, T.StringType):
        return cell
    # ANSI casts raise; try_cast leaves text alone.
    def number(x: Column) -> Column:
        return F.struct(F.lit(0).alias("t"), x.try_cast("double").alias("d"), F.btrim(x).try_cast("decimal(38,18)").alias("e"), F.lit("").alias("s"))

    def part(x: Column) -> Column:
        text = F.struct(F.lit(1).alias("t"), F.lit(0.0).alias("d"), F.lit(0).cast("decimal(38,18)").alias("e"), x.alias("s"))
        return F.when(x.rlike(r"\A[0-9]"), number(x)).otherwise(text)

    parts = F.transform(F.regexp_extract_all(cell, F.lit(r"([0-9]+|[^0-9]+)"), 1), part)
    whole = F.array(number(F.regexp_replace(cell, r"\s", "")))
    return F.when(cell.isNull(), F.slice(whole, 1, 0)).when(cell.rlike(NUMBER), whole).otherwise(parts)


def natural_number(cell: Column, dtype: T.DataType) -> Column:
    """The cell as a number for sums; null stays null, text that is no number raises."""
    if is_numeric(dtype):
        return cell
    clean = F.regexp_replace(cell, r"\s", "")
    return F.when(cell.isNull(), F.lit(None).cast("double")).when(
        cell.rlike(r"\A\s*-?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?\s*\z"), clean.try_cast("double")
    ).otherwise(F.raise_error(F.concat(F.lit("not a number: "), cell)).cast("double"))


def number_text(number: Column) -> Column:
    """A floating-point number as users write it: plain digits from 0.0001 up to 16 digits, else with an exponent of two digits at least."""
    text = number.cast("string")
    far_off = r"\A(-?)([0-9]+)\.([0-9]+)E(-?[0-9]+)\z"
    sign, whole, part, exponent = (F.regexp_extract(text, far_off, i) for i in (1, 2, 3, 4))
    power = exponent.try_cast("int")
    fraction = F.when(part == "0", F.lit("")).otherwise(part)
    digits = F.concat(whole, fraction)
    places = F.length(fraction)
    large = F.when(places <= power, F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))).otherwise(
        F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(whole, F.lit("."), part, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    plain = F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(far)
    return F.when(text.rlike(far_off), F.concat(sign, plain)).otherwise(text)


def cell_text(cell: Column, dtype: T.DataType) -> Column:
    """A cell as the text that a file gets."""
    return number_text(cell) if isinstance(dtype, (T.DoubleType, T.FloatType)) else cell.cast("string")
