from __future__ import annotations

import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hrsight.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, driver_memory="8g")
    yield s


def hr_frame(n: int = 300, seed: int = 7, nulls: bool = True) -> pd.DataFrame:
    """Small HR table with the sample header, random values and some NULLs."""
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({
        "EmployeeID": [f"E{i:04d}" for i in range(n)],
        "Age": rng.integers(20, 60, n),
        "Gender": rng.choice(["Female", "Male"], n),
        "Department": rng.choice(["Sales", "HR", "IT", "R&D"], n),
        "JobRole": rng.choice(["Analyst", "Manager", "Engineer"], n),
        "Education": rng.choice(["Bachelor", "Master", "PhD"], n),
        "MonthlyIncome": rng.integers(1000, 9000, n).astype(float),
        "YearsAtCompany": rng.integers(0, 20, n),
        "YearsSinceLastPromotion": rng.integers(0, 10, n),
        "TrainingTimesLastYear": rng.integers(0, 7, n),
        "JobSatisfaction": rng.integers(1, 5, n),
        "EnvironmentSatisfaction": rng.integers(1, 5, n),
        "WorkLifeBalance": rng.integers(1, 5, n),
        "JobInvolvement": rng.integers(1, 5, n),
        "PerformanceRating": rng.choice([3, 4], n, p=[0.8, 0.2]),
        "OverTime": rng.choice(["Yes", "No"], n, p=[0.3, 0.7]),
        "Attrition": rng.choice(["Yes", "No"], n, p=[0.3, 0.7]),
    })
    if nulls:
        df["MonthlyIncome"] = df["MonthlyIncome"].astype(object)
        df.loc[rng.choice(n, 10, replace=False), "MonthlyIncome"] = None
        df.loc[rng.choice(n, 8, replace=False), "OverTime"] = None
        df.loc[rng.choice(n, 5, replace=False), "Department"] = None
        df.loc[rng.choice(n, 6, replace=False), "Attrition"] = None
    return df


SCHEMA = ("EmployeeID string, Age int, Gender string, Department string, JobRole string, Education string, "
          "MonthlyIncome double, YearsAtCompany int, YearsSinceLastPromotion int, TrainingTimesLastYear int, "
          "JobSatisfaction int, EnvironmentSatisfaction int, WorkLifeBalance int, JobInvolvement int, "
          "PerformanceRating int, OverTime string, Attrition string")


def to_spark(spark, pdf: pd.DataFrame, schema: str = SCHEMA):
    rows = [tuple(None if (v is None or (isinstance(v, float) and np.isnan(v))) else
                  (v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def left_flag(s: pd.Series) -> pd.Series:
    return s.astype(str).str.lower().isin(["yes", "1", "true", "left"])


def py_rate(sub: pd.DataFrame) -> float:
    if len(sub) == 0:
        return 0.0
    return round(left_flag(sub["Attrition"]).sum() / len(sub) * 100, 2)
