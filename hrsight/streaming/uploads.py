"""Uploads as a stream.

The batch flow "a CSV file arrives -> it is validated, profiled, logged and
the dashboard metrics refresh" becomes a Structured Streaming job over the
upload folder:

* ``upload_stream``: the file source over ``*.csv`` files with a declared
  schema (streams need one), tagged with the file each row came from;
* ``live_attrition``: headcount, leavers and attrition rate per (file,
  group), a stateful streaming aggregation whose state is one row per
  group (update/complete output), so the dashboard figures follow the
  arriving files without recomputing old ones. With ``keep`` the state of a
  file is dropped that long after its arrival (update output);
* ``log_uploads``: per micro-batch, one activity-log row per new file
  ("Uploaded N rows, C columns"). A batch writes to a folder of its own,
  named by query and batch number, and overwrites it, and the row ids follow
  from query, batch and file: a batch that is retried writes the same rows
  again, so a file is logged exactly once. The query checkpoint goes under the
  session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hrsight.functions.exprs import col, count_if, label_flag, pct
from hrsight.roles import Roles
from hrsight.session import scratch_path
from hrsight.sources.csv import CSV_GLOB, QUOTING


def upload_stream(spark: SparkSession, folder: str, schema: StructType | str,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = (spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", CSV_GLOB))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.options(**QUOTING).option("multiLine", True).csv(folder).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_name").alias("dataset_name"))


def live_attrition(stream: DataFrame, roles: Roles | None = None, by: str = "department",
                   keep: str | None = None) -> DataFrame:
    """Running headcount / leavers / rate per (file, group) of a stream."""
    roles = Roles.of(roles)
    key = roles.col(stream, by) or by
    flag = label_flag(stream, roles)
    leavers = count_if(flag) if flag is not None else F.lit(0).cast("long")
    if keep is not None:
        stream = stream.withWatermark("arrived", keep)
    agg = (stream.where(col(key).isNotNull())
           .groupBy("file", "arrived", "dataset_name", col(key).alias("group"))
           .agg(F.count(F.lit(1)).alias("employees"), leavers.alias("leavers")))
    return agg.withColumn("attrition_rate", pct(F.col("leavers"), F.col("employees")))


def log_uploads(stream: DataFrame, log_path: str, user_id: int, query_name: str = "upload-log",
                checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    spark = stream.sparkSession
    n_cols = len([c for c in stream.columns if c not in ("dataset_name", "file", "arrived")])

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        per_file = batch.groupBy("file", "dataset_name").agg(F.count(F.lit(1)).alias("n"))
        rows = per_file.select(
            F.md5(F.concat_ws("|", F.lit(query_name), F.lit(str(epoch_id)), "file")).alias("id"), F.lit(user_id).cast("bigint").alias("user_id"),
            F.lit("upload").alias("action"), "dataset_name",
            F.concat(F.lit("Uploaded "), F.col("n").cast("string"), F.lit(f" rows, {n_cols} columns"))
            .alias("details"),
            F.current_timestamp().alias("timestamp"))
        rows.write.mode("overwrite").parquet(f"{log_path}/{query_name}-{epoch_id}")

    writer = (stream.writeStream.queryName(query_name).foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint or scratch_path(spark, f"stream-{query_name}")))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
