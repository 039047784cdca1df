"""Dense row numbers that follow from the rows alone.

``with_index`` numbers the rows of a frame 0, 1, 2, ... in the order of a digest
of their content, so a recomputed, repartitioned or reread frame gets the same
numbers; equal rows get consecutive ones.

Plan: rows are written once with their digest (a run number that comes from
physical partitions must not change between the steps that use it) and counted
for each (digest, run), a run being the equal rows of one written part. The
digest's first digits name a bucket; running sums within buckets, and over the
fixed number of buckets, give each run its first number, and a run's rows are
numbered on their own. No task gets more than a bucket's counts or the equal
rows of one written part, also where a third of all rows are copies of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hrsight.functions.exprs import col
from hrsight.session import scratch_path

#: Leading hex digits of a digest that name its bucket: 65,536 buckets.
BUCKET_DIGITS = 4


def content_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """md5 of the texts of the columns, each led by its length; NULL differs from the empty text. Binary values are
    written in hex; maps are taken as their entries in order of keys."""
    parts = []
    for name in columns or df.columns:
        kind, value = df.schema[name].dataType.typeName(), col(name)
        if kind == "binary":
            value = F.hex(value)
        elif kind == "map":
            value = F.array_sort(F.map_entries(value))
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.md5(F.concat(*parts)) if parts else F.md5(F.lit(""))


def with_index(df: DataFrame, name: str = "index", columns: list[str] | None = None) -> DataFrame:
    """``df`` with the long column ``name``: the row's place, from 0, in the order of the digest of ``columns`` (all).

    Rows that agree in ``columns`` get consecutive numbers in no defined order, so choose columns that tell rows
    apart if it matters. A column called ``name`` is replaced. The rows are written once, to the shared folder."""
    src = df.drop(name)
    used = [c for c in columns or df.columns if c in src.columns]
    taken = set(src.columns) | {name}
    digest, run, row, first, bucket, n = (_free(c, taken) for c in ("_digest", "_run", "_row", "_first", "_bucket", "_n"))
    start = _free("_start", taken)
    path = scratch_path(df.sparkSession, f"rows-{uuid.uuid4().hex}")
    src.select(*[col(c) for c in src.columns], content_digest(src, used).alias(digest), F.spark_partition_id().alias(run),
               F.monotonically_increasing_id().alias(row)).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)

    runs = rows.groupBy(digest, run).agg(F.count(F.lit(1)).alias(n)).withColumn(bucket, F.substring(digest, 1, BUCKET_DIGITS))
    inside = Window.partitionBy(bucket).orderBy(digest, run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(first, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    # one row for each bucket, 65,536 at most
    starts = (rows.groupBy(F.substring(digest, 1, BUCKET_DIGITS).alias(bucket)).agg(F.count(F.lit(1)).alias(n))
              .select(bucket, F.coalesce(F.sum(n).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)),
                                         F.lit(0)).alias(start)))
    runs = runs.join(F.broadcast(starts), bucket).select(digest, run, (F.col(first) + F.col(start)).alias(first))
    own = Window.partitionBy(digest, run).orderBy(row)
    return (rows.withColumn(n, F.row_number().over(own) - 1).join(runs, [digest, run])
            .select(*[col(c) for c in src.columns], (F.col(first) + F.col(n)).cast("long").alias(name)))


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name
