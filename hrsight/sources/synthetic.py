"""Synthetic HR table (S5) and its label refinement.

Rows are generated from a frame of ids (``spark.range(n)`` or any key
column): every random draw is a hash of (id, column number, seed) scaled to
(0, 1) (``functions/draws.py``), so a row's values do not depend on
partitioning, reruns or recomputed partitions, and the same rows follow from
SQL text elsewhere (``generate_sql``). Distributions: normal, lognormal and
exponential by inverse CDF, Poisson (inverse-CDF ladder, clipped so it is
finite), weighted and uniform choices.

The label refinement adds a risk score in integer hundredths (the same
decisions as the float sums, all 64 combinations checked) and flips labels
with a further hash draw. The bottom-quartile income it needs is one exact
quantile, computed once (not per row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrsight.functions import draws as D
from hrsight.functions.quantiles import exact_quantile

# Category lists and weights of the generator.
DEPARTMENTS = ["Sales", "R&D", "HR", "IT", "Finance", "Marketing", "Operations"]
JOB_ROLES = ["Manager", "Senior", "Junior", "Analyst", "Engineer", "Specialist", "Director"]
EDUCATION = ["High School", "Bachelor", "Master", "PhD"]
GENDERS = ["Male", "Female"]
TRAVEL = ["Non-Travel", "Travel_Rarely", "Travel_Frequently"]
MARITAL = ["Single", "Married", "Divorced"]
RATING_P = [(3, 0.85), (4, 0.15)]
OVERTIME_P = [("Yes", 0.3), ("No", 0.7)]
STOCK_P = [(0, 0.4), (1, 0.3), (2, 0.2), (3, 0.1)]
ATTRITION_P = [("Yes", 0.16), ("No", 0.84)]
# Refinement weights in hundredths and flip rules.
RISK_WEIGHTS = {"low_sat": 30, "overtime": 20, "promo_gap": 15, "low_income": 15, "low_wlb": 10, "low_env": 10}
FLIP_UP_ABOVE, FLIP_DOWN_BELOW, FLIP_DOWN_P = 40, 10, 0.5

ID = "_id"


#: Stream of the flip draw of the refinement, after those of the columns.
FLIP_STREAM = 64


def _columns() -> list[tuple[str, Callable[[str], str]]]:
    """(column, SQL text of its value from the text of its uniform); column i draws from stream i."""
    def normal(lo, hi, mean, sd):
        return lambda u: D.clipped(D.normal(u, mean, sd), lo, hi)

    def exponential(lo, hi, scale):
        return lambda u: D.clipped(D.exponential(u, scale), lo, hi)

    def integer(lo, hi):
        return lambda u: D.integer(u, lo, hi)

    def choice(values):
        return lambda u: D.choice(u, values)

    def weighted(steps):
        return lambda u: D.ladder(u, steps)

    def poisson(lam, cap):
        return lambda u: D.poisson(u, lam, cap)

    return [
        ("Age", normal(18, 65, 35.0, 10.0)),
        ("Gender", choice(GENDERS)),
        ("Department", choice(DEPARTMENTS)),
        ("JobRole", choice(JOB_ROLES)),
        ("Education", choice(EDUCATION)),
        ("EducationLevel", integer(1, 5)),
        ("MonthlyIncome", lambda u: f"CAST(floor(exp({D.normal(u, 8.0, 0.5)})) AS INT)"),
        ("DailyRate", integer(100, 1500)),
        ("HourlyRate", integer(15, 100)),
        ("PercentSalaryHike", integer(0, 25)),
        ("TotalWorkingYears", exponential(0, 40, 10.0)),
        ("YearsAtCompany", exponential(0, 40, 5.0)),
        ("YearsInCurrentRole", exponential(0, 20, 3.0)),
        ("YearsSinceLastPromotion", exponential(0, 15, 2.0)),
        ("YearsWithCurrManager", exponential(0, 17, 3.0)),
        ("JobSatisfaction", integer(1, 5)),
        ("EnvironmentSatisfaction", integer(1, 5)),
        ("WorkLifeBalance", integer(1, 5)),
        ("JobInvolvement", integer(1, 5)),
        ("PerformanceRating", weighted(RATING_P)),
        ("OverTime", weighted(OVERTIME_P)),
        ("BusinessTravel", choice(TRAVEL)),
        ("MaritalStatus", choice(MARITAL)),
        ("NumCompaniesWorked", poisson(2.0, 10)),
        ("TrainingTimesLastYear", poisson(3.0, 6)),
        ("StockOptionLevel", weighted(STOCK_P)),
        ("DistanceFromHome", exponential(1, 30, 5.0)),
        ("Attrition", weighted(ATTRITION_P)),
    ]


def _key(id_sql: str) -> str:
    return f"CAST({id_sql} AS STRING)"


def generate(ids: DataFrame, seed: int = 42, id_col: str = "id") -> DataFrame:
    """28-column synthetic employee table, one row per row of ``ids``."""
    columns = _columns()
    src = ids.select(F.col(id_col).alias(ID))
    drawn = src.select(ID, *[F.expr(D.uniform(_key(ID), i, seed)).alias(f"_u{i}") for i in range(len(columns))])
    return drawn.select(ID, *[F.expr(make(f"_u{i}")).alias(name) for i, (name, make) in enumerate(columns)])


def generate_sql(ids_sql: str, seed: int = 42) -> str:
    """``generate`` as DuckDB SQL over a query with the column ``_id``."""
    columns = _columns()
    drawn = ", ".join(f"{D.uniform(_key(ID), i, seed, D.DUCKDB)} AS _u{i}" for i in range(len(columns)))
    made = ", ".join(f'{make(f"_u{i}")} AS {name}' for i, (name, make) in enumerate(columns))
    return f"SELECT {ID}, {made} FROM (SELECT {ID}, {drawn} FROM ({ids_sql}))"


def risk_hundredths(df: DataFrame, q25: float | None) -> Column:
    """Refinement risk score in hundredths (0..100)."""
    parts = [(F.col("JobSatisfaction") <= 2, RISK_WEIGHTS["low_sat"]),
             (F.col("OverTime") == "Yes", RISK_WEIGHTS["overtime"]),
             (F.col("YearsSinceLastPromotion") > 5, RISK_WEIGHTS["promo_gap"]),
             (F.col("MonthlyIncome") < F.lit(q25), RISK_WEIGHTS["low_income"]),
             (F.col("WorkLifeBalance") <= 2, RISK_WEIGHTS["low_wlb"]),
             (F.col("EnvironmentSatisfaction") <= 2, RISK_WEIGHTS["low_env"])]
    out = F.lit(0)
    for cond, w in parts:
        out = out + F.when(F.coalesce(cond, F.lit(False)), F.lit(w)).otherwise(F.lit(0))
    return out


def refine_labels(df: DataFrame, seed: int = 42, keep_score: bool = False) -> DataFrame:
    """Flip "No" to "Yes" with probability score when score > 0.40, and
    "Yes" to "No" with probability 0.5 when score < 0.10. Needs the id
    column ``_id`` of ``generate`` for its draws."""
    q25 = exact_quantile(df, "MonthlyIncome", 0.25)
    score = risk_hundredths(df, q25)
    u = F.expr(D.uniform(_key(ID), FLIP_STREAM, seed))
    a = F.col("Attrition")
    new = (F.when((F.col("_risk") > FLIP_UP_ABOVE) & (a == "No") & (u < F.col("_risk") / 100.0), F.lit("Yes"))
           .when((F.col("_risk") < FLIP_DOWN_BELOW) & (a == "Yes") & (u < FLIP_DOWN_P), F.lit("No"))
           .otherwise(a))
    out = df.withColumn("_risk", score).withColumn("Attrition", new)
    return out if keep_score else out.drop("_risk")


def synthetic_employees(spark: SparkSession, n: int = 1000, seed: int = 42, keep_id: bool = False) -> DataFrame:
    """``n`` refined synthetic rows (the demo table)."""
    out = refine_labels(generate(spark.range(n), seed), seed)
    return out if keep_id else out.drop(ID)
