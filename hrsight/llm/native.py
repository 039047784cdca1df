"""Word and shingle expressions in built-in SQL functions, shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of characters other than `[\\x20\\x09-\\x0D]`; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def grams(word_list: Column, size: int) -> Column:
    """Fingerprints of all `size`-word windows of an array column, in order; `word_list` must be a plain column."""
    n = F.size(word_list)
    return F.when(n >= size, F.transform(
        F.sequence(F.lit(0), n - size),
        lambda i: F.xxhash64(*[F.get(word_list, i + j) for j in range(size)]))).otherwise(
            F.array().cast("array<bigint>"))
