"""Distinct counts from small mergeable states.

``distinct_states`` keeps one HyperLogLog sketch for each (key, column), a few
kB whatever the data's size: for uploads, one state row for each upload and
column, stored beside the upload and never computed again. ``distinct_counts``
unites any choice of states, so a count over months of uploads reads no upload.
Values that stand in several uploads count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.functions.exprs import col, group_cols

#: log2 of a sketch's registers.
LG_REGISTERS = 14


def relative_error(lg_registers: int = LG_REGISTERS) -> float:
    """Relative standard error of a united sketch."""
    return 1.04 / math.sqrt(1 << lg_registers)


def distinct_states(df: DataFrame, columns: Sequence[str] | None = None, by: str | Iterable[str] | None = None,
                    lg_registers: int = LG_REGISTERS) -> DataFrame:
    """Rows (by..., column, sketch, n): a sketch of the column's values as text, and how many are not NULL."""
    keys = group_cols(by)
    cols = list(columns or [c for c in df.columns if c not in keys])
    named = [col(k) for k in keys]
    if not cols:
        return df.select(*named, F.lit("").alias("column"), F.lit(b"").alias("sketch"), F.lit(0).cast("long").alias("n")).limit(0)
    parts = []
    for i, c in enumerate(cols):
        text = col(c).cast("string")
        parts += [F.hll_sketch_agg(text, F.lit(lg_registers)).alias(f"_s{i}"), F.count(text).alias(f"_n{i}")]
    state = df.groupBy(*named).agg(*parts)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("sketch"), F.col(f"_n{i}").alias("n"))
                      for i, c in enumerate(cols)])
    return state.select(*named, F.explode(items).alias("s")).select(*named, "s.*")


def merged_states(states: DataFrame, by: str | Iterable[str] | None = None) -> DataFrame:
    """States of coarser keys: one for each (by..., column)."""
    named = [col(k) for k in group_cols(by)]
    return states.groupBy(*named, "column").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))


def distinct_counts(states: DataFrame, by: str | Iterable[str] | None = None, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """Rows (by..., column, n_distinct, low, high, n): estimate, its bounds at three standard errors, values that
    are not NULL (no count is above them)."""
    named = [col(k) for k in group_cols(by)]
    merged = merged_states(states, by).select(*named, "column", "n", F.hll_sketch_estimate("sketch").alias("e"))
    slack = 3.0 * relative_error(lg_registers)
    return merged.select(
        *named, "column", F.least("e", "n").alias("n_distinct"), F.floor(F.col("e") * (1.0 - slack)).alias("low"),
        F.least(F.ceil(F.col("e") * (1.0 + slack)), F.col("n")).alias("high"), "n")
