import numpy as np
import pandas as pd
import pytest
from conftest import hr_frame, left_flag, py_rate, to_spark

from pyspark.sql import functions as F

from hrsight.functions import exprs
from hrsight.operators import describe
from hrsight.roles import Roles


@pytest.fixture(scope="module")
def data(spark):
    pdf = hr_frame()
    return pdf, to_spark(spark, pdf)


def test_overall_rate_counts_null_labels_in_denominator(data):
    pdf, df = data
    r = describe.attrition_rate(df).collect()[0]
    assert r["employees"] == len(pdf)
    assert r["attrition_rate"] == py_rate(pdf)


def test_rate_by_department_drops_null_group(data):
    pdf, df = data
    got = {r["Department"]: r["attrition_rate"] for r in describe.attrition_rate(df, by="Department").collect()}
    want = {d: py_rate(pdf[pdf["Department"] == d]) for d in pdf["Department"].dropna().unique()}
    assert got == want
    assert None not in got


@pytest.mark.parametrize("schema,values,expected", [
    ("Attrition int", [(1,), (0,), (1,), (None,)], 50.0),
    ("Attrition boolean", [(True,), (False,), (None,), (False,)], 25.0),
    ("Left string", [("left",), ("TRUE",), ("no",), (None,)], 50.0),
    ("turnover string", [("1",), ("0",)], 50.0),
])
def test_label_variants(spark, schema, values, expected):
    df = spark.createDataFrame(values, schema)
    assert describe.attrition_rate(df).collect()[0]["attrition_rate"] == expected


def test_empty_and_missing_label(spark):
    empty = spark.createDataFrame([], "Attrition string")
    assert describe.attrition_rate(empty).collect()[0]["attrition_rate"] == 0.0
    nolabel = spark.createDataFrame([("a",)], "x string")
    assert describe.attrition_rate(nolabel).collect()[0]["attrition_rate"] == 0.0


def test_department_metrics(data):
    pdf, df = data
    rows = {r["department"]: r for r in describe.department_metrics(df).collect()}
    for d, sub in pdf.dropna(subset=["Department"]).groupby("Department"):
        r = rows[d]
        assert r["employee_count"] == len(sub)
        assert r["avg_age"] == round(sub["Age"].mean(), 1)
        assert r["avg_income"] == pytest.approx(round(pd.to_numeric(sub["MonthlyIncome"]).mean(), 0))
        assert r["avg_satisfaction"] == round(sub["JobSatisfaction"].mean(), 2)
        assert r["attrition_rate"] == py_rate(sub)
        assert r["band"] == ("danger" if r["attrition_rate"] > 20 else
                             "warning" if r["attrition_rate"] > 10 else "success")


def test_overview(data):
    pdf, df = data
    r = describe.overview(df).collect()[0]
    assert r["total_employees"] == len(pdf)
    assert r["total_departments"] == pdf["Department"].nunique()
    assert r["avg_tenure"] == round(pdf["YearsAtCompany"].mean(), 1)


def test_salary_stats_exact(data):
    pdf, df = data
    inc = pd.to_numeric(pdf["MonthlyIncome"]).dropna()
    r = describe.salary_stats(df).collect()[0]
    assert r["median"] == round(inc.median(), 0)
    assert r["q25"] == round(inc.quantile(0.25), 0)
    assert r["q75"] == round(inc.quantile(0.75), 0)
    assert r["std"] == round(inc.std(), 0)


def test_salary_stats_by_group_exact(data):
    pdf, df = data
    rows = describe.salary_stats(df, by="Gender").collect()
    assert {r["Gender"] for r in rows} == set(pdf["Gender"])
    for r in rows:
        inc = pd.to_numeric(pdf["MonthlyIncome"])[pdf["Gender"] == r["Gender"]].dropna()
        assert (r["median"], r["q25"], r["q75"]) == tuple(round(inc.quantile(p), 0) for p in (0.5, 0.25, 0.75))
    both = describe.salary_stats(df, by=["Gender", "Department"]).collect()
    assert len(both) == len(pdf.groupby(["Gender", "Department"], dropna=False))


def test_pay_by_group_grouping_sets(data):
    pdf, df = data
    got = {(r["dimension"], r["value"]): r["avg_income"] for r in describe.pay_by_group(df).collect()}
    inc = pd.to_numeric(pdf["MonthlyIncome"])
    for dim, col in (("gender", "Gender"), ("department", "Department"), ("job_role", "JobRole")):
        for v, m in inc.groupby(pdf[col]).mean().items():
            assert got[(dim, v)] == pytest.approx(round(m, 0))
    assert not any(v is None for _, v in got)


def test_distribution_ties_and_share(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "v string")
    rows = describe.distribution(df, "v").collect()
    assert [(r["value"], r["n"]) for r in rows] == [("a", 2), ("b", 2), ("c", 1)]
    assert rows[0]["share_pct"] == 40.0


def test_performer_counts(data):
    pdf, df = data
    r = describe.performer_counts(df).collect()[0]
    q75 = pdf["PerformanceRating"].quantile(0.75)
    q25 = pdf["PerformanceRating"].quantile(0.25)
    assert r["high_performer_count"] == (pdf["PerformanceRating"] >= q75).sum()
    assert r["underperformer_count"] == (pdf["PerformanceRating"] <= q25).sum()
    assert r["high_performer_pct"] == round((pdf["PerformanceRating"] >= q75).sum() / len(pdf) * 100, 1)


def test_histogram_covers_all_rows(data):
    pdf, df = data
    rows = describe.histogram(df, "Age", 20).collect()
    assert sum(r["n"] for r in rows) == len(pdf)
    assert max(r["bin"] for r in rows) <= 19


def test_crosstab_long_and_wide(data):
    pdf, df = data
    long = describe.attrition_crosstab(df).collect()
    sub = pdf.dropna(subset=["Department"])
    assert sum(r.employees > 0 for r in long) == sub.groupby(["Department", "JobRole"]).ngroups
    assert len(long) == sub["Department"].nunique() * sub["JobRole"].nunique()
    wide = describe.attrition_crosstab(df, wide=sorted(pdf["JobRole"].unique()))
    assert set(wide.columns) == {"department", *pdf["JobRole"].unique()}


def test_satisfaction_levels_series_names(data):
    pdf, df = data
    names = {r["series"] for r in describe.satisfaction_levels(df).collect()}
    assert names == {"Job Sat", "Environment Sat", "WorkLife Balance", "JobInvolvement"}


def test_pay_gap_tie_break(spark):
    df = spark.createDataFrame([("B", 100.0), ("A", 100.0), ("C", 50.0)], "Department string, MonthlyIncome double")
    r = describe.department_pay_gap(df).collect()[0]
    assert r["max_department"] == "A" and r["min_department"] == "C"
    assert r["pay_gap_pct"] == round(50 / (250 / 3) * 100, 2)


def test_roles_map_other_names(spark):
    df = spark.createDataFrame([("x", "yes"), ("x", "no"), ("y", "no")], "team string, quit string")
    roles = Roles.of({"department": "team"}, label="quit")
    rows = {r["department"]: r["attrition_rate"] for r in describe.department_metrics(df, roles).collect()}
    assert rows == {"x": 50.0, "y": 0.0}


def test_left_flag_helper_matches_reference_rule():
    s = pd.Series(["Yes", "no", "LEFT", "1", None, "true"])
    assert left_flag(s).tolist() == [True, False, True, True, False, True]
    assert np.isclose(py_rate(pd.DataFrame({"Attrition": s})), 66.67)


def test_headers_with_dots_and_spaces(spark):
    from hrsight.operators import findings, scores
    df = spark.createDataFrame([("A.x", 1000.0, 2, "Yes"), ("A.x", 3000.0, 4, "No"), ("B y", 2000.0, 1, "No")],
                               "`Dept.Name` string, `Monthly Income` double, `Job Sat` int, Attrition string")
    roles = Roles.of({"department": "Dept.Name", "income": "Monthly Income", "satisfaction": "Job Sat"})
    rows = {r["department"]: r["attrition_rate"] for r in describe.department_metrics(df, roles).collect()}
    assert rows == {"A.x": 50.0, "B y": 0.0}
    assert describe.salary_stats(df, roles).collect()[0]["median"] == 2000.0
    assert describe.attrition_rate(df, roles, by="Dept.Name").count() == 2
    assert scores.workforce_scores(df, roles).collect()[0]["department_stability_score"] is not None
    assert findings.recommendations(df, roles).count() >= 1


def test_safe_divide_and_number_format(spark):
    rows = [(6.0, 4.0, "2.005"), (1.0, 0.0, "text"), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, t string")
    got = df.select(exprs.safe_divide(F.col("a"), F.col("b")).alias("q"), exprs.safe_divide(F.col("a"), F.col("b"), -1.0).alias("d"),
                    exprs.format_decimals(F.col("t"), 1).alias("f"), exprs.title_key(F.lit("avg_income")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(1.5, 1.5, "2.0", "Avg Income"), (0.0, -1.0, "text", "Avg Income"), (0.0, -1.0, None, "Avg Income")]
