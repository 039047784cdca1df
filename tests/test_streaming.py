import os
import tempfile
import uuid

from hrsight.session import scratch_path
from hrsight.sources import logs
from hrsight.streaming import uploads

SCHEMA = "EmployeeID string, Department string, Attrition string"


def _csv(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write("EmployeeID,Department,Attrition\n" + "".join(",".join(r) + "\n" for r in rows))


def test_upload_stream_logs_each_file_once(spark):
    folder = tempfile.mkdtemp(prefix="hrsight-uploads-")
    _csv(folder, "a.csv", [("1", "HR", "Yes"), ("2", "HR", "No")])
    _csv(folder, "b.CSV", [("3", "IT", "No")])
    _csv(folder, "notes.txt", [("x", "y", "z")])
    tag = uuid.uuid4().hex
    log_path = scratch_path(spark, f"test-stream-log-{tag}")
    ckpt = scratch_path(spark, f"test-stream-ckpt-{tag}")
    stream = uploads.upload_stream(spark, folder, SCHEMA)
    q = uploads.log_uploads(stream, log_path, user_id=7, query_name=f"q{tag[:8]}", checkpoint=ckpt,
                            available_now=True)
    q.awaitTermination(120)
    got = {r["dataset_name"]: r["details"] for r in logs.read_log(spark, log_path).collect()}
    assert got == {"a.csv": "Uploaded 2 rows, 3 columns", "b.CSV": "Uploaded 1 rows, 3 columns"}
    # A restart with the same checkpoint only sees new files.
    _csv(folder, "c.csv", [("4", "IT", "Yes")])
    q = uploads.log_uploads(uploads.upload_stream(spark, folder, SCHEMA), log_path, user_id=7,
                            query_name=f"r{tag[:8]}", checkpoint=ckpt, available_now=True)
    q.awaitTermination(120)
    assert sorted(r["dataset_name"] for r in logs.read_log(spark, log_path).collect()) == ["a.csv", "b.CSV", "c.csv"]


def test_live_attrition_memory_sink(spark):
    folder = tempfile.mkdtemp(prefix="hrsight-uploads-")
    _csv(folder, "a.csv", [("1", "HR", "Yes"), ("2", "HR", "No"), ("3", "IT", "No")])
    name = "live_" + uuid.uuid4().hex[:8]
    agg = uploads.live_attrition(uploads.upload_stream(spark, folder, SCHEMA))
    q = (agg.writeStream.outputMode("complete").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, f"test-live-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["group"]: (r["employees"], r["attrition_rate"]) for r in spark.table(name).collect()}
    assert got == {"HR": (2, 50.0), "IT": (1, 0.0)}


def test_retried_batch_writes_the_same_rows(spark):
    """The batch function of a query that is run again over the same files, with a fresh checkpoint, replaces its rows."""
    folder = tempfile.mkdtemp(prefix="hrsight-uploads-")
    os.makedirs(os.path.join(folder, "x"))
    os.makedirs(os.path.join(folder, "y"))
    _csv(os.path.join(folder, "x"), "a.csv", [("1", "HR", "Yes")])
    _csv(os.path.join(folder, "y"), "a.csv", [("2", "HR", "No"), ("3", "HR", "No")])
    log_path = scratch_path(spark, f"test-stream-log-{uuid.uuid4().hex}")
    seen = []
    for turn in range(2):
        stream = uploads.upload_stream(spark, folder + "/*", SCHEMA)
        q = uploads.log_uploads(stream, log_path, user_id=7, query_name="again", available_now=True,
                                checkpoint=scratch_path(spark, f"test-stream-ckpt-{uuid.uuid4().hex}"))
        q.awaitTermination(120)
        seen.append(sorted((r["id"], r["details"]) for r in logs.read_log(spark, log_path).collect()))
    assert seen[0] == seen[1]
    assert [d for _, d in sorted(seen[0], key=lambda x: x[1])] == ["Uploaded 1 rows, 3 columns", "Uploaded 2 rows, 3 columns"]
