"""Activity log and report registry reads.

The log is an append-only table (see ``hrsight.sources.logs``). "Latest n
per user" is ``row_number`` over (user) ordered by time descending, filtered
to n: Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a
user with a third of all events still sends only n rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_user(log: DataFrame, n: int = 50, user_col: str = "user_id", ts_col: str = "timestamp",
                    tie_col: str | None = "id") -> DataFrame:
    order = [F.desc(ts_col)] + ([F.desc(tie_col)] if tie_col else [])
    w = Window.partitionBy(user_col).orderBy(*order)
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def history(log: DataFrame, user_id=None, limit: int = 50, user_col: str = "user_id",
            ts_col: str = "timestamp", tie_col: str | None = "id") -> DataFrame:
    """Newest ``limit`` entries, optionally of one user (top-k read).
    ``user_id`` may be a value or a Column (e.g. a scalar subquery)."""
    if user_id is None:
        out = log
    else:
        out = log.where(F.col(user_col) == (user_id if isinstance(user_id, Column) else F.lit(user_id)))
    order = [F.desc(ts_col)] + ([F.desc(tie_col)] if tie_col else [])
    return out.orderBy(*order).limit(limit)
