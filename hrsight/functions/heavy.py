"""The most frequent values of columns, exactly, without shuffling all values.

1. Every task keeps a bounded summary of fingerprints and counts for each column
   (Misra-Gries: when too many are held, the count that just misses is taken off
   all and added to the summary's error). Summaries add up: a value's count is
   between the sum of its kept counts and that sum plus the sum of the errors.
2. The best candidates are counted exactly, by value: rows are matched with a
   broadcast table of candidate fingerprints, whose size is a parameter.
3. No other value can be more frequent than the best count left out plus the
   error. Where that is below the last count of the top list, the list is proven.
   Otherwise the summaries are widened to what the counts found call for, and the
   steps repeat. A column whose counts are so flat that this would exceed
   ``limit`` (near-unique ids) is grouped in full, as nothing less is exact.

Fingerprints that collide share a count, which only raises bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrsight.functions.exprs import categorical_columns, col

SCHEMA = "column string, rank int, value string, n long"
_STATE = "i int, h bigint, n bigint, err bigint"


def _compact(values, counts, capacity: int):
    """(values, counts, error): one entry for each value, at most ``capacity`` of them."""
    import numpy as np

    values, at = np.unique(np.concatenate(values), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate(counts), minlength=len(values)).astype(np.int64)
    if len(values) <= capacity:
        return values, counts, 0
    miss = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    kept = counts > miss
    return values[kept], counts[kept] - miss, miss


def _summaries(indexes: Sequence[int], capacity: int):
    """Arrow batches of fingerprints, a column for each of ``indexes`` -> the task's summaries; the row without a
    fingerprint holds the number of values seen and the error."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator["pa.RecordBatch"]):
        held = {i: ([np.empty(0, np.int64)], [np.empty(0, np.int64)]) for i in indexes}
        seen, err, waiting = dict.fromkeys(indexes, 0), dict.fromkeys(indexes, 0), dict.fromkeys(indexes, 0)
        for batch in batches:
            for i, values in zip(indexes, batch.columns):
                v, n = np.unique(values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
                seen[i] += int(n.sum())
                waiting[i] += len(v)
                held[i][0].append(v)
                held[i][1].append(n)
                if waiting[i] > 2 * capacity:
                    v, n, miss = _compact(*held[i], capacity)
                    held[i], waiting[i], err[i] = ([v], [n]), len(v), err[i] + miss
        for i in indexes:
            v, n, miss = _compact(*held[i], capacity)
            k = len(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (k + 1), pa.int32()), pa.array([*v.tolist(), None], pa.int64()),
                 pa.array([*n.tolist(), seen[i]], pa.int64()), pa.array([0] * k + [err[i] + miss], pa.int64())],
                names=["i", "h", "n", "err"])

    return run


def _ranked(counts: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_values(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5, capacity: int = 1024,
               limit: int = 1 << 17) -> DataFrame:
    """Rows (column, rank, value, n): the ``top`` most frequent values of every column (text columns by default) as
    text, by count descending, then value ascending. NULL is no value; a column without values gives no rows.

    ``capacity``: fingerprints in a first summary and candidates of a column; ``limit``: the widest summary. Neither
    changes the result."""
    spark = df.sparkSession
    cols = list(columns or categorical_columns(df))
    if not cols:
        return spark.createDataFrame([], SCHEMA)
    src = df.select(*[col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)])

    def rows(indexes):
        items = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value")) for i in indexes])
        return src.select(F.explode(items).alias("s")).select("s.*").where(F.col("value").isNotNull())

    found, todo = [], list(range(len(cols)))
    while todo:
        state = (src.select(*[F.when(F.col(f"v{i}").isNotNull(), F.xxhash64(f"v{i}")).alias(f"h{i}") for i in todo])
                 .mapInArrow(_summaries(todo, capacity), _STATE).persist(StorageLevel.MEMORY_AND_DISK))
        totals = {r["i"]: r for r in state.where("h IS NULL").groupBy("i").agg(F.sum("n").alias("n"), F.sum("err").alias("err")).collect()}
        best_first = Window.partitionBy("i").orderBy(F.desc("low"), "h")
        kept = (state.where("h IS NOT NULL").groupBy("i", "h").agg(F.sum("n").alias("low"))
                .withColumn("r", F.row_number().over(best_first)).where(F.col("r") <= capacity + 1))
        missed = {r["i"]: r["low"] for r in kept.where(F.col("r") > capacity).select("i", "low").collect()}
        # at most `capacity` fingerprints of a column
        chosen = F.broadcast(kept.where(F.col("r") <= capacity).select("i", "h"))
        counts = (rows(todo).withColumn("h", F.xxhash64("value")).join(chosen, ["i", "h"], "left_semi")
                  .groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")))
        best = _ranked(counts, top).persist(StorageLevel.MEMORY_AND_DISK)
        last = {r["i"]: (r["k"], r["n"]) for r in best.groupBy("i").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).collect()}
        state.unpersist()

        proven, wider, flat = [], [], []
        for i in todo:
            beyond = totals[i]["err"] + missed.get(i, 0) if i in totals else 0
            k, n = last.get(i, (0, 0))
            if beyond == 0 or (k == top and n > beyond):
                proven.append(i)
                continue
            # the error of summaries of c entries is under rows / c
            need = 4 * totals[i]["n"] // max(n, 1)
            (wider if k == top and capacity < need <= limit else flat).append((i, need))
        if proven:
            found.append(best.where(F.col("i").isin(proven)))
        if flat:
            found.append(_ranked(rows([i for i, _ in flat]).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")), top))
        todo = [i for i, _ in wider]
        capacity = max([need for _, need in wider], default=capacity)
    names = F.array(*[F.lit(c) for c in cols])
    return reduce(DataFrame.unionByName, found).select(
        F.element_at(names, F.col("i") + 1).alias("column"), F.col("rank").cast("int").alias("rank"), "value", "n")
