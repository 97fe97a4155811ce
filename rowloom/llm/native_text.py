"""Column expressions on texts, shared by the operators that run without Python workers."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words once A-Z are lower-cased: every ASCII character but 0-9 and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates blank-delimited words.
BLANKS = r"[\x20\x09-\x0D]+"


#: Rows of a table that is broadcast at most; both sides of its join are shuffled beyond.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Array of words, lower-cased in every script; empty for a null or wordless text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def ascii_words(text: Column) -> Column:
    """Array of words of which A-Z alone is lower-cased; empty for a null or wordless text."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(plain, SEPARATORS), "")


def within(rows: int, table: DataFrame) -> DataFrame:
    """The table, to be broadcast where its counted rows allow it."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def grams(array: Column, k: int) -> Column:
    """Every run of k words, joined by a blank; empty if there are fewer."""
    n = F.size(array) - k + 1
    run = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(array, i, k), " "))
    return F.when(n > 0, run).otherwise(F.array().cast("array<string>"))


def gram_hashes(array: Column, k: int) -> Column:
    """The 64-bit hash of every run of k words, made from the words as they are; empty if there are fewer."""
    n = F.size(array) - k + 1
    run = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(array, i, k)))
    return F.when(n > 0, run).otherwise(F.array().cast("array<bigint>"))


def unit_hash(seed: str, value: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
