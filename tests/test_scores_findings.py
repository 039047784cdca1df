import numpy as np
import pandas as pd
import pytest
from conftest import hr_frame, left_flag, py_rate, to_spark

from hrsight.operators import findings, scores


@pytest.fixture(scope="module")
def data(spark):
    pdf = hr_frame(seed=11, nulls=False)
    return pdf, to_spark(spark, pdf)


def brute_scores(pdf: pd.DataFrame) -> dict:
    r = py_rate(pdf)
    m = {c: pdf[c].mean() for c in ("JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance",
                                     "JobInvolvement", "PerformanceRating", "YearsAtCompany",
                                     "TrainingTimesLastYear")}
    health = [m["JobSatisfaction"] / 4 * 100, m["EnvironmentSatisfaction"] / 4 * 100,
              m["WorkLifeBalance"] / 4 * 100, max(0, min(100, (m["PerformanceRating"] - 3) * 100)),
              max(0, 100 - r * 5)]
    eng = [m["JobInvolvement"] / 4 * 100, m["JobSatisfaction"] / 4 * 100, m["EnvironmentSatisfaction"] / 4 * 100]
    stab = [max(0, 100 - py_rate(s) * 3) for _, s in pdf.groupby("Department")]
    risk = []
    if r > 10:
        risk.append(min(100, r * 5))
    if m["JobSatisfaction"] < 2.5:
        risk.append(70)
    if m["WorkLifeBalance"] < 2.5:
        risk.append(60)
    prod = [m["PerformanceRating"] / 4 * 100, min(100, m["YearsAtCompany"] / 10 * 100),
            min(100, m["TrainingTimesLastYear"] / 5 * 100)]
    return {"workforce_health_score": round(np.mean(health), 1), "engagement_score": round(np.mean(eng), 1),
            "department_stability_score": round(np.mean(stab), 1),
            "workforce_risk_index": round(np.mean(risk), 1) if risk else round(r * 3, 1),
            "retention_effectiveness": round(max(0, 100 - r * 4), 1),
            "productivity_score": round(np.mean(prod), 1)}


def test_scores_match_definitions(data):
    pdf, df = data
    got = scores.workforce_scores(df).collect()[0].asDict()
    for k, v in brute_scores(pdf).items():
        assert got[k] == pytest.approx(v, abs=1e-9), k


def test_scores_by_group(data):
    pdf, df = data
    rows = {r["Gender"]: r.asDict() for r in scores.workforce_scores(df, by="Gender").collect()}
    for g, sub in pdf.groupby("Gender"):
        for k, v in brute_scores(sub).items():
            assert rows[g][k] == pytest.approx(v, abs=1e-9), (g, k)


def test_scores_average_present_parts_only(spark):
    df = spark.createDataFrame([(2, 4, "No"), (4, 4, "No")], "JobSatisfaction int, JobInvolvement int, Attrition string")
    r = scores.workforce_scores(df).collect()[0]
    # health: sat 75 and retention 100; engagement: involvement 100 and sat 75
    assert r["workforce_health_score"] == 87.5
    assert r["engagement_score"] == 87.5
    assert r["productivity_score"] is None
    assert r["department_stability_score"] is None


def brute_recs(pdf: pd.DataFrame):
    out = []
    for d, sub in sorted(pdf.groupby("Department")):
        if py_rate(sub) > 20:
            out.append((1, d, py_rate(sub)))
    inc = pd.to_numeric(pdf["MonthlyIncome"])
    li = py_rate(pdf[inc < inc.quantile(0.25)])
    if li > 15:
        out.append((2, "Low-income employees", li))
    low = (pdf["JobSatisfaction"] <= 2).sum()
    if low > len(pdf) * 0.15:
        out.append((3, "Low satisfaction employees", round(low / len(pdf) * 100, 2)))
    ot = py_rate(pdf[pdf["OverTime"].astype(str).str.lower().isin(["yes", "1", "true"])])
    if ot > 20:
        out.append((4, "Overtime employees", ot))
    pr = py_rate(pdf[pdf["YearsSinceLastPromotion"] > 5])
    if pr > 15:
        out.append((5, "Long-tenure without promotion", pr))
    return out or [(6, "All employees", None)]


def test_recommendations_match_rules(data):
    pdf, df = data
    got = [(r["rule_no"], r["target"], r["metric_value"]) for r in findings.recommendations(df).collect()]
    assert got == brute_recs(pdf)


def test_recommendation_texts(data):
    pdf, df = data
    rows = findings.recommendations(df).collect()
    r1 = [r for r in rows if r["rule_no"] == 1][0]
    assert r1["issue"] == f"{r1['metric_value']:.1f}% of the department left"
    assert r1["action_plan"][0] == f"Collect leaving reasons in {r1['target']} for the past year"
    r3 = [r for r in rows if r["rule_no"] == 3]
    if r3:
        k = r3[0]["employees"]
        assert r3[0]["issue"] == f"{k} employees, {k / len(pdf) * 100:.1f}% of all, are at satisfaction 1 or 2"


def test_general_recommendation_when_nothing_fires(data):
    _, df = data
    rows = findings.recommendations(df, dept_rate=101, low_income_rate=101, low_sat_share=1.0,
                                    overtime_rate=101, promo_rate=101).collect()
    assert [(r["rule_no"], r["category"], r["priority"]) for r in rows] == [(6, "General", "Low")]


def test_thresholds_are_strict(spark):
    # Department rate exactly 20.00: no Department Risk row.
    rows = [("A", "Yes")] + [("A", "No")] * 4
    df = spark.createDataFrame(rows, "Department string, Attrition string")
    got = findings.recommendations(df).collect()
    assert [r["rule_no"] for r in got] == [6]


def test_format_matches_python_half_even_on_binary_value(spark):
    df = spark.createDataFrame([(54.55,)], "x double")
    import pyspark.sql.functions as F
    assert df.select(findings._fmt1(F.col("x"))).collect()[0][0] == f"{54.55:.1f}"


def test_insights_match_rules(data):
    pdf, df = data
    got = {r["rule_no"]: r for r in findings.insights(df).collect()}
    ot = pdf["OverTime"].astype(str).str.lower().isin(["yes", "1", "true"])
    a, b = py_rate(pdf[ot]), py_rate(pdf[~ot])
    assert (1 in got) == (a > b * 1.5)
    inc = pd.to_numeric(pdf["MonthlyIncome"])
    a, b = py_rate(pdf[inc < inc.median()]), py_rate(pdf[inc >= inc.median()])
    assert (2 in got) == (a > b * 1.5)
    a, b = py_rate(pdf[pdf["JobSatisfaction"] <= 2]), py_rate(pdf[pdf["JobSatisfaction"] >= 4])
    assert (3 in got) == (a > b * 2)
    means = inc.groupby(pdf["Department"]).mean()
    gap = (means.max() - means.min()) / means.mean() * 100
    assert (4 in got) == (gap > 30)


def test_age_and_pay_insights(spark):
    df = spark.createDataFrame([("A", 1000.0, 50), ("B", 3000.0, 52)],
                               "Department string, MonthlyIncome double, Age int")
    got = {r["rule_no"]: r for r in findings.insights(df).collect()}
    assert set(got) == {4, 5}
    assert got[4]["insight"] == "Mean income is 3000 in B and 1000 in A."
    assert got[5]["insight"].startswith("The mean age is 51.0 years.")


def test_overtime_complement_keeps_nulls(spark):
    rows = [("Yes", "Yes"), ("Yes", "Yes"), (None, "Yes"), ("No", "No"), (None, "No"), ("No", "No")]
    df = spark.createDataFrame(rows, "OverTime string, Attrition string")
    ev, _ = findings._evidence(df, findings.Roles.of(), findings.THRESHOLDS)
    r = ev.collect()[0]
    assert r["overtime_rate"] == 100.0
    assert r["no_overtime_rate"] == 25.0  # 1 of the 4 non-overtime rows (2 of them NULL)
    assert left_flag(pd.Series(["x"])).tolist() == [False]
