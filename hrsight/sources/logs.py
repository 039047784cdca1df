"""Append-only activity log (S12), report registry (S13) and JSON document
scan with a default (S14).

Each append writes new parquet files next to the old ones and commits them with
one row (``append_once``), so writers never rewrite the store, and a write that
is repeated under its id counts once. Row ids follow from the write id (a
fresh uuid where the caller names none); times are ``current_timestamp()``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITY_SCHEMA = ("id string, user_id bigint, action string, dataset_name string, details string, "
                   "timestamp timestamp")
REPORT_SCHEMA = "id string, user_id bigint, filename string, format string, type string, created_at timestamp"


#: Folder of the commit rows; listings of the log skip names that begin with an underscore.
COMMITS = "_commits"
COMMIT_SCHEMA = "write_id string, attempt string, n bigint, committed timestamp"


def _nothing_there(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "") or "PATH_NOT_FOUND" in str(e)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:
        if not _nothing_there(e):
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Rows (write_id, attempt, n, committed): the attempt that counts for each write, the first one committed."""
    return (_read(spark, f"{path}/{COMMITS}", COMMIT_SCHEMA).groupBy("write_id")
            .agg(F.min(F.struct("committed", "attempt", "n")).alias("c"))
            .select("write_id", "c.attempt", "c.n", "c.committed"))


def append_once(df: DataFrame, path: str, write_id: str) -> bool:
    """Append ``df`` under a write id; False when that id is there already.

    An attempt writes to a folder of its own and is then named by one commit row.
    Readers see the rows of committed attempts only, and one attempt for each id:
    a writer that dies half-way leaves nothing to be seen, one that is run again,
    or twice at a time, counts once."""
    spark = df.sparkSession
    if not commits(spark, path).where(F.col("write_id") == write_id).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    folder = f"{path}/attempt={attempt}"
    df.write.parquet(folder)
    row = spark.read.schema(df.schema).parquet(folder).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(write_id).alias("write_id"), F.lit(attempt).alias("attempt"), "n", F.current_timestamp().alias("committed"))
    row.write.mode("append").parquet(f"{path}/{COMMITS}")
    return True


def _row(spark: SparkSession, values: tuple, schema: str, write_id: str, time: str) -> DataFrame:
    row = spark.createDataFrame([values], schema)
    return row.select(F.md5(F.lit(write_id)).alias("id"), *row.columns, F.current_timestamp().alias(time))


def log_activity(spark: SparkSession, path: str, user_id: int, action: str, dataset_name: str,
                 details: str, write_id: str | None = None) -> bool:
    """One row of the activity log. A caller that may be run again names the write; without a name every call counts."""
    write_id = write_id or uuid.uuid4().hex
    return append_once(_row(spark, (user_id, action, dataset_name, details), "user_id bigint, action string, "
                            "dataset_name string, details string", write_id, "timestamp"), path, write_id)


def log_report(spark: SparkSession, path: str, user_id: int, filename: str, fmt: str,
               kind: str = "analytics", write_id: str | None = None) -> bool:
    """One row of the report registry; ``write_id`` as in ``log_activity``."""
    write_id = write_id or uuid.uuid4().hex
    return append_once(_row(spark, (user_id, filename, fmt, kind), "user_id bigint, filename string, format string, "
                            "type string", write_id, "created_at"), path, write_id)


def read_log(spark: SparkSession, path: str, schema: str = ACTIVITY_SCHEMA) -> DataFrame:
    """The log table, or an empty one when nothing was written yet. Rows of attempts count if committed; rows outside
    of attempts (the upload stream's own folders, which a retried batch overwrites) always do. Any other
    failure (an unreachable store, say) is raised, not read as an empty log."""
    try:
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
        names = rows.columns
        rows = rows.select("*", F.regexp_extract("_metadata.file_path", "/attempt=([0-9a-f]+)/", 1).alias("_attempt"))
    except AnalysisException as e:
        if not _nothing_there(e):
            raise
        return spark.createDataFrame([], schema)
    counted = commits(spark, path).select(F.col("attempt").alias("_attempt"))
    kept = rows.where("_attempt != ''").join(counted, "_attempt", "left_semi")
    return rows.where("_attempt = ''").unionByName(kept).select(*names)


def read_json_entries(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Entries of a ``{key: [ ... ]}`` JSON document; an empty frame when the
    file is missing or does not parse (the default)."""
    fields = ",".join(":".join(p.strip().split(" ", 1)) for p in schema.split(","))
    try:
        doc = (spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
               .schema(f"{key} array<struct<{fields}>>").json(path))
    except AnalysisException as e:
        if not _nothing_there(e):
            raise
        return spark.createDataFrame([], schema)
    return doc.select(F.explode(key).alias("e")).select("e.*")
