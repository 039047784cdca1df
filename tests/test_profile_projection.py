import pandas as pd
import pyspark.sql.functions as F
import pytest
from conftest import hr_frame, py_rate, to_spark

from hrsight.operators import activity, lookup, profile, projection


@pytest.fixture(scope="module")
def data(spark):
    pdf = hr_frame(seed=5)
    return pdf, to_spark(spark, pdf)


def test_null_profile(data):
    pdf, df = data
    rows = {r["column"]: r for r in profile.null_profile(df).collect()}
    assert rows["MonthlyIncome"]["null_count"] == 10
    assert rows["MonthlyIncome"]["null_pct"] == round(10 / len(pdf) * 100, 2)
    assert rows["Age"]["rows"] == len(pdf) and rows["Age"]["columns"] == len(pdf.columns)


def test_numeric_profile(data):
    pdf, df = data
    rows = {r["column"]: r for r in profile.numeric_profile(df).collect()}
    inc = pd.to_numeric(pdf["MonthlyIncome"])
    assert rows["MonthlyIncome"]["median"] == round(inc.median(), 2)
    assert rows["MonthlyIncome"]["std"] == round(inc.std(), 2)
    assert rows["Age"]["mean"] == round(pdf["Age"].mean(), 2)


def test_numeric_profile_all_null(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "a double, b int")
    r = {x["column"]: x for x in profile.numeric_profile(df).collect()}
    assert r["a"]["mean"] is None and r["a"]["median"] is None
    assert r["b"]["median"] == 1.5


def test_categorical_profile_top5(data):
    pdf, df = data
    rows = profile.categorical_profile(df, ["Department", "EmployeeID"]).collect()
    dept = [r for r in rows if r["column"] == "Department"]
    vc = pdf["Department"].value_counts()
    assert dept[0]["unique_count"] == pdf["Department"].nunique()
    assert [(r["value"], r["n"]) for r in dept] == sorted(vc.items(), key=lambda t: (-t[1], t[0]))[:5]
    ids = [r["value"] for r in rows if r["column"] == "EmployeeID"]
    assert ids == sorted(pdf["EmployeeID"])[:5]


def test_correlation_pairwise_and_constant(spark):
    rows = [(1.0, 2.0, 5.0, None), (2.0, 4.1, 5.0, 1.0), (3.0, 6.3, 5.0, 3.0), (4.0, None, 5.0, 2.0),
            (5.0, 9.9, 5.0, 7.0)]
    pdf = pd.DataFrame(rows, columns=["a", "b", "c", "d"])
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["x"], r["y"]): r["r"] for r in profile.correlation_matrix(df).collect()}
    want = pdf.corr()
    for x in "abd":
        for y in "abd":
            assert got[(x, y)] == pytest.approx(round(want.loc[x, y], 6), abs=1e-6)
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert len(got) == 16


def test_projection_closed_form_equals_recurrence(data):
    pdf, df = data
    rows = projection.projection(df, periods=12).collect()
    r0, n0 = py_rate(pdf), len(pdf)
    size = n0
    for m, row in enumerate(rows, start=1):
        rate = max(0, min(50, max(5, r0 * (0.98 ** m))))
        dep = int(size * rate / 100 / 12)
        hire = dep + int(n0 * 0.02 / 12)
        size = size - dep + hire
        assert (row["month"], row["projected_departures"], row["hiring_needed"], row["projected_size"]) == \
            (m, dep, hire, size)
        assert row["projected_attrition_rate"] == round(rate, 2)


def test_projection_noise_is_deterministic(data):
    _, df = data
    a = projection.projection(df, by="Department", noise_sd=0.5).collect()
    b = projection.projection(df, by="Department", noise_sd=0.5).collect()
    assert a == b
    assert all(5.0 <= r["projected_attrition_rate"] <= 50.0 for r in a)
    s = projection.projection_series(projection.projection(df)).collect()
    assert {r["series"] for r in s} == {"Attrition %", "Workforce Size"} and s[0]["x"].startswith("M")


def test_search_and_preview(data):
    pdf, df = data
    got = [r["EmployeeID"] for r in lookup.employee_search(df, "e001").collect()]
    assert got == sorted(i for i in pdf["EmployeeID"] if "e001" in i.lower())[:20]
    assert [r["department"] for r in lookup.department_search(df, "R").collect()] == ["HR", "R&D"]
    prev = lookup.preview(df, n=50, as_text=True).collect()
    assert len(prev) == 50 and all(isinstance(v, str) for v in prev[0])
    regex = lookup.employee_search(df, "^e00[12]", regex=True).collect()
    assert len(regex) == 20


def test_latest_per_user(spark):
    rows = [(u, "2024-01-0%d" % d, f"e{d}") for u in (1, 2) for d in range(1, 8)]
    log = spark.createDataFrame(rows, "user_id int, ts string, id string").withColumn("timestamp", F.to_timestamp("ts"))
    got = activity.latest_per_user(log, 3).collect()
    assert len(got) == 6 and {r["id"] for r in got} == {"e7", "e6", "e5"}
    hist = activity.history(log, user_id=1, limit=2).collect()
    assert [r["id"] for r in hist] == ["e7", "e6"] and {r["user_id"] for r in hist} == {1}


def test_correlation_far_from_zero_missing_and_wide(spark):
    """Values around 1e9, NULL and NaN in different rows, constants, more columns than a block; against pandas."""
    import numpy as np

    rng = np.random.default_rng(12)
    n, k = 400, profile.BLOCK + 6
    base = rng.normal(0, 1, (n, k)) + rng.normal(0, 1, (n, 1))
    base[:, 0] = base[:, 0] * 1e-3 + 1e9
    base[:, 1] = 7.3
    base[rng.random((n, k)) < 0.2] = np.nan
    rows = [tuple(None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(base)]
    names = [f"c {j}" for j in range(k)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(7)
    got = {(r.x, r.y): r.r for r in profile.correlation_matrix(df).collect()}
    base[:, 0] -= 1e9  # exact, and pandas loses digits far from zero
    want = pd.DataFrame(base, columns=names).corr()
    assert len(got) == k * k
    for a in names:
        for b in names:
            w = want.loc[a, b]
            if "c 1" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(w, abs=3e-6)
    assert all(r.r is None for r in profile.correlation_matrix(df.limit(0)).collect())
