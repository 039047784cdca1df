import itertools
import os
import uuid
import tempfile

import pytest
from pyspark.sql import functions as F

from hrsight.plans import report
from hrsight.session import scratch_path
from hrsight.sources import csv, logs, synthetic


def _write(path, text, bom=False):
    with open(path, "wb") as f:
        f.write((b"\xef\xbb\xbf" if bom else b"") + text.encode())


def test_csv_bom_na_tokens_and_types(spark):
    d = tempfile.mkdtemp(prefix="hrsight-test-")
    p = os.path.join(d, "emp.CSV")
    _write(p, "EmployeeID,Age,MonthlyIncome,OverTime,Attrition\nE1,30,1000.5,Yes,No\n"
              "E2,NA,2000,N/A,Yes\nE3,41,null,None,No\n", bom=True)
    df = csv.read_employees(spark, d)
    assert df.columns[0] == "EmployeeID"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types == {"EmployeeID": "string", "Age": "int", "MonthlyIncome": "double", "OverTime": "string",
                     "Attrition": "string"}
    rows = df.orderBy("EmployeeID").collect()
    assert rows[1]["Age"] is None and rows[1]["OverTime"] is None and rows[2]["MonthlyIncome"] is None


def test_validation_reports_problems(spark):
    d = tempfile.mkdtemp(prefix="hrsight-test-")
    empty = os.path.join(d, "empty.csv")
    _write(empty, "")
    assert "0 bytes" in csv.problems(csv.validate(spark, empty))
    header = os.path.join(d, "header.csv")
    _write(header, "a,b\n")
    assert csv.problems(csv.validate(spark, header)) == ["no record after the header"]
    good = os.path.join(d, "good.csv")
    _write(good, "a,b\n1,2\n")
    assert csv.problems(csv.validate(spark, good)) == []
    assert csv.problems(csv.validate(spark, good, max_bytes=3)) == [f"{os.path.getsize(good)} bytes, limit 3"]
    assert csv.problems(csv.validate(spark, os.path.join(d, "missing.csv")))
    assert csv.allowed_file("x.CsV") and not csv.allowed_file("x.txt") and not csv.allowed_file("csv")


def test_csv_write_read_roundtrip(spark):
    df = synthetic.synthetic_employees(spark, 50)
    path = scratch_path(spark, "test-csv-roundtrip")
    csv.write_employees(df, path)
    back = csv.read_employees(spark, path)
    assert back.count() == 50 and set(back.columns) == set(df.columns)


def test_synthetic_moments(spark):
    df = synthetic.generate(spark.range(20000)).cache()
    m = df.agg(F.avg("Age").alias("age"), F.min("Age").alias("amin"), F.max("Age").alias("amax"),
               F.avg(F.when(F.col("OverTime") == "Yes", 1).otherwise(0)).alias("ot"),
               F.avg(F.when(F.col("PerformanceRating") == 4, 1).otherwise(0)).alias("r4"),
               F.avg("TrainingTimesLastYear").alias("tr"), F.max("TrainingTimesLastYear").alias("trmax"),
               F.expr("percentile(MonthlyIncome, 0.5)").alias("inc_med"),
               F.count_distinct("Department").alias("depts"),
               F.avg(F.when(F.col("Attrition") == "Yes", 1).otherwise(0)).alias("att")).collect()[0]
    assert 34 < m["age"] < 36 and m["amin"] >= 18 and m["amax"] <= 65
    assert 0.28 < m["ot"] < 0.32 and 0.13 < m["r4"] < 0.17
    assert m["trmax"] == 6 and 2.8 < m["tr"] < 3.1
    assert 2800 < m["inc_med"] < 3150  # exp(8) ~ 2981
    assert m["depts"] == 7 and 0.14 < m["att"] < 0.18
    a = synthetic.generate(spark.range(100).repartition(7)).orderBy("_id").collect()
    b = synthetic.generate(spark.range(100)).orderBy("_id").collect()
    assert a == b  # independent of partitioning


def test_label_rule_all_combinations(spark):
    rows = []
    for bits in itertools.product([0, 1], repeat=6):
        rows.append((1 if bits[0] else 3, "Yes" if bits[1] else "No", 6 if bits[2] else 1,
                     100 if bits[3] else 10_000, 1 if bits[4] else 3, 1 if bits[5] else 3))
    df = spark.createDataFrame(rows, "JobSatisfaction int, OverTime string, YearsSinceLastPromotion int, "
                                     "MonthlyIncome int, WorkLifeBalance int, EnvironmentSatisfaction int")
    got = df.select(synthetic.risk_hundredths(df, 5000).alias("k")).collect()
    weights = [0.3, 0.2, 0.15, 0.15, 0.1, 0.1]
    for bits, r in zip(itertools.product([0, 1], repeat=6), got):
        s = 0
        for b, w in zip(bits, weights):
            if b:
                s += w
        assert (s > 0.4) == (r["k"] > 40) and (s < 0.1) == (r["k"] < 10)


def test_refinement_only_flips_eligible_rows(spark):
    base = synthetic.generate(spark.range(3000))
    refined = synthetic.refine_labels(base, keep_score=True)
    j = base.select("_id", F.col("Attrition").alias("before")).join(refined, "_id")
    bad = j.where((F.col("before") != F.col("Attrition")) &
                  ~(((F.col("_risk") > 40) & (F.col("before") == "No")) |
                    ((F.col("_risk") < 10) & (F.col("before") == "Yes")))).count()
    assert bad == 0
    assert j.where(F.col("before") != F.col("Attrition")).count() > 0


def test_logs_append_and_read(spark):
    path = scratch_path(spark, f"test-log-{os.getpid()}")
    assert logs.read_log(spark, path).count() == 0
    logs.log_activity(spark, path, 1, "upload", "a.csv", "Uploaded 3 rows, 2 columns")
    logs.log_activity(spark, path, 2, "demo", "demo.csv", "Loaded")
    log = logs.read_log(spark, path)
    assert log.count() == 2 and log.where("user_id = 1").collect()[0]["action"] == "upload"
    rpath = scratch_path(spark, f"test-reports-{os.getpid()}")
    logs.log_report(spark, rpath, 1, "report_x.json", "json")
    assert logs.read_log(spark, rpath, logs.REPORT_SCHEMA).collect()[0]["format"] == "json"


def test_repeated_and_half_written_appends_count_once(spark):
    path = scratch_path(spark, f"test-once-{uuid.uuid4().hex}")
    rows = spark.range(50).select(F.col("id").cast("string").alias("id"), F.lit(3).cast("bigint").alias("user_id"))
    schema = "id string, user_id bigint"
    assert logs.append_once(rows, path, "w1") and not logs.append_once(rows, path, "w1")
    # an attempt that died before its commit, and one with the data of another writer of the same id committed later
    rows.write.parquet(f"{path}/attempt={'0' * 32}")
    assert logs.read_log(spark, path, schema).count() == 50
    late = "f" * 32
    rows.write.parquet(f"{path}/attempt={late}")
    (spark.createDataFrame([("w1", late, 50)], "write_id string, attempt string, n bigint")
     .withColumn("committed", F.current_timestamp()).write.mode("append").parquet(f"{path}/{logs.COMMITS}"))
    assert logs.read_log(spark, path, schema).count() == 50
    assert logs.append_once(rows.limit(7), path, "w2") and logs.append_once(rows.limit(0), path, "w3")
    assert not logs.append_once(rows, path, "w3")
    got = logs.read_log(spark, path, schema)
    assert got.count() == 57 and got.columns == ["id", "user_id"]
    assert sorted((r["write_id"], r["n"]) for r in logs.commits(spark, path).collect()) == [("w1", 50), ("w2", 7), ("w3", 0)]
    other = scratch_path(spark, f"test-once-{uuid.uuid4().hex}")
    assert logs.log_activity(spark, other, 1, "upload", "a.csv", "x", write_id="u1")
    assert not logs.log_activity(spark, other, 1, "upload", "a.csv", "x", write_id="u1")
    assert logs.log_activity(spark, other, 1, "upload", "a.csv", "x")
    ids = [r["id"] for r in logs.read_log(spark, other).collect()]
    assert len(ids) == 2 == len(set(ids))


def test_json_entries_default(spark):
    d = tempfile.mkdtemp(prefix="hrsight-test-")
    good = os.path.join(d, "h.json")
    _write(good, '{"entries": [{"user_id": 1, "action": "upload"}, {"user_id": 2, "action": "train"}]}')
    got = logs.read_json_entries(spark, good, "entries", "user_id bigint, action string")
    assert sorted(r["action"] for r in got.collect()) == ["train", "upload"]
    missing = logs.read_json_entries(spark, os.path.join(d, "nope.json"), "entries", "user_id bigint")
    assert missing.count() == 0


def test_report_sections_and_text(spark):
    df = synthetic.synthetic_employees(spark, 300)
    sec = report.report_sections(df)
    keys = {(r["section"], r["key"]) for r in sec.collect()}
    assert ("overview", "total_employees") in keys and ("scores", "workforce_health_score") in keys
    labels = {r["label"] for r in sec.where("section = 'overview'").collect()}
    assert "Total Employees" in labels
    lines = [r["line"] for r in report.text_lines(sec).collect()]
    assert lines[0].startswith("total_employees: 300")
    assert any(line.startswith("[") for line in lines)
    out = scratch_path(spark, f"test-report-{os.getpid()}")
    report.write_text_report(sec, out)
    assert spark.read.text(out).count() == len(lines)


@pytest.mark.parametrize("n", [1])
def test_one_row_table(spark, n):
    from hrsight.operators import describe, profile
    df = synthetic.synthetic_employees(spark, n)
    assert describe.salary_stats(df).collect()[0]["std"] is None
    corr = profile.correlation_matrix(df, ["Age", "MonthlyIncome"]).collect()
    assert all(r["r"] is None for r in corr)


def test_json_report_sink_and_filename(spark):
    from datetime import datetime
    df = synthetic.synthetic_employees(spark, 200)
    sec = report.report_sections(df)
    out = scratch_path(spark, f"test-json-report-{os.getpid()}")
    report.write_json_report(sec, out)
    back = spark.read.json(out)
    assert back.count() == sec.count() and set(back.columns) == set(sec.columns)
    assert report.report_filename("json", datetime(2026, 6, 12, 10, 20, 59)) == "report_20260612_102059.json"


def test_wide_crosstab_takes_its_columns_from_the_caller(spark):
    from hrsight.operators import describe
    df = synthetic.synthetic_employees(spark, 200)
    assert describe.attrition_crosstab(df, wide=synthetic.JOB_ROLES).columns == ["department", *synthetic.JOB_ROLES]


def test_crosstab_of_many_roles(spark):
    from hrsight.operators import describe
    rows = [("A" if i % 2 else "B", f"role{i}", "Yes") for i in range(1500)]
    df = spark.createDataFrame(rows, "Department string, JobRole string, Attrition string")
    got = describe.attrition_crosstab(df).collect()
    assert len(got) == 3000 and sum(r.employees for r in got) == 1500
    assert {r.attrition_pct for r in got if not r.employees} == {0.0}


def test_quoted_cells_read_as_written(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    with open(path, "w", newline="") as f:
        f.write('EmployeeID,Title,Age\r\nE1,"He said ""hi"", ok",30\r\nE2,"two\nlines",31\r\nE3,plain,\r\n')
    rows = csv.read_employees(spark, path).orderBy("EmployeeID").collect()
    assert [tuple(r) for r in rows] == [("E1", 'He said "hi", ok', 30), ("E2", "two\nlines", 31), ("E3", "plain", None)]
    assert csv.problems(csv.validate(spark, path)) == []


def test_round_trip_of_awkward_cells(spark):
    rows = [("E1", 'a "quoted" word', 1.5), ("E2", "new\nline, comma", None), ("E3", 'back\\slash\\', 2.0), ("E4", '"', -0.25)]
    df = spark.createDataFrame(rows, "EmployeeID string, note string, x double")
    path = scratch_path(spark, "awkward-csv")
    csv.write_employees(df, path)
    assert sorted(map(tuple, csv.read_employees(spark, path).collect())) == sorted(rows)


def test_number_suffixes_stay_text_and_odd_headers_work(spark, tmp_path):
    path = str(tmp_path / "n.csv")
    with open(path, "w") as f:
        f.write("room,a`b,x.y,n,big,flag\n1D,1,0.5, 7 ,3000000000,true\n2F,2,1e3,8,1,FALSE\n3d,,-.5,9,2,True\n")
    df = csv.read_employees(spark, path)
    assert dict(df.dtypes) == {"room": "string", "a`b": "int", "x.y": "double", "n": "int", "big": "bigint", "flag": "boolean"}
    assert [r[0] for r in df.orderBy("room").collect()] == ["1D", "2F", "3d"]


def test_records_with_more_fields_do_not_parse(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,2\n1,2,3,4\n5\n")
    found = {r.check: (r.ok, r.detail) for r in csv.validate(spark, path).collect()}
    assert found["parses"] == (False, "1 record(s) with more fields than the header's 2") and found["has_rows"][0]


def test_unreadable_store_is_an_error_not_an_empty_log(spark, tmp_path):
    assert logs.read_log(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        logs.read_log(spark, "nosuchfs://host/path").count()


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    from hrsight import session
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake)
