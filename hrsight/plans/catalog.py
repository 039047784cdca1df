"""Named queries over the test tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir)`` returns a lazy DataFrame built by the
library operators on the employee view (or on the raw tables); ``ORACLES``
holds the equivalent SQL text for DuckDB (the employee view is the CTE
``emp``). Names of computed columns are the same on both sides.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from hrsight.functions import draws, heavy
from hrsight.operators import activity, describe, findings, lookup, profile, projection, rowindex, scores, sketches
from hrsight.roles import Roles
from hrsight.sources import synthetic
from hrsight.sources.fixture import employee_view, table, with_emp

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
ROLES = Roles.of()


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---- SQL helpers for the oracle side -------------------------------------

LEFT = "coalesce(lower(Attrition) IN ('yes', '1', 'true', 'left'), false)"


def cnt_if(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def pct_sql(k: str, n: str, digits: int = 2) -> str:
    return (f"round_even(coalesce(CAST({k} AS DOUBLE) / nullif(CAST({n} AS DOUBLE), 0), 0.0) "
            f"* 100.0, {digits})")


def rate_sql(where: str | None = None) -> str:
    if where is None:
        return pct_sql(cnt_if(LEFT), "count(*)")
    return pct_sql(cnt_if(f"({where}) AND {LEFT}"), cnt_if(where))


def band_sql(col: str, high: float = 20, mid: float | None = 10) -> str:
    mid_part = f" WHEN {col} > {mid} THEN 'warning'" if mid is not None else ""
    return f"CASE WHEN {col} > {high} THEN 'danger'{mid_part} ELSE 'success' END"


def emp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return employee_view(spark, sf_dir)


# ---- A1 / A18 ------------------------------------------------------------

register("attrition_rate", with_emp(f"""
SELECT *, {band_sql('attrition_rate', 15, None)} AS band FROM (
  SELECT count(*) AS employees, {cnt_if(LEFT)} AS leavers, {rate_sql()} AS attrition_rate FROM emp)
"""))(lambda spark, sf: describe.attrition_rate(emp(spark, sf), ROLES))

for _name, _col in (("attrition_by_department", "Department"), ("attrition_by_role", "JobRole"),
                    ("attrition_by_gender", "Gender")):
    register(_name, with_emp(f"""
SELECT *, {band_sql('attrition_rate')} AS band FROM (
  SELECT {_col}, count(*) AS employees, {cnt_if(LEFT)} AS leavers, {rate_sql()} AS attrition_rate
  FROM emp WHERE {_col} IS NOT NULL GROUP BY {_col})
"""))(lambda spark, sf, _c=_col: describe.attrition_rate(emp(spark, sf), ROLES, by=_c))


# ---- A2 - A4, A28 --------------------------------------------------------

register("overview", with_emp(f"""
SELECT count(*) AS total_employees, count(DISTINCT Department) AS total_departments,
  count(DISTINCT JobRole) AS total_job_roles, round_even(avg(Age), 1) AS avg_age,
  round_even(avg(MonthlyIncome), 0) AS avg_income, round_even(avg(YearsAtCompany), 1) AS avg_tenure,
  {rate_sql()} AS attrition_rate
FROM emp
"""))(lambda spark, sf: describe.overview(emp(spark, sf), ROLES))

for _role, _col in (("gender", "Gender"), ("department", "Department"), ("education", "Education")):
    register(f"distribution_{_role}", with_emp(f"""
SELECT value, n, {pct_sql('n', 'sum(n) OVER ()')} AS share_pct FROM (
  SELECT {_col} AS value, count(*) AS n FROM emp WHERE {_col} IS NOT NULL GROUP BY {_col})
"""))(lambda spark, sf, _r=_role: describe.role_distribution(emp(spark, sf), ROLES, _r))


# ---- A5 - A10 ------------------------------------------------------------

register("department_metrics", with_emp(f"""
SELECT *, {band_sql('attrition_rate')} AS band FROM (
  SELECT Department AS department, count(*) AS employee_count, round_even(avg(Age), 1) AS avg_age,
    round_even(avg(MonthlyIncome), 0) AS avg_income, round_even(avg(YearsAtCompany), 1) AS avg_tenure,
    round_even(avg(JobSatisfaction), 2) AS avg_satisfaction,
    round_even(avg(PerformanceRating), 2) AS avg_performance, {rate_sql()} AS attrition_rate
  FROM emp WHERE Department IS NOT NULL GROUP BY Department)
"""))(lambda spark, sf: describe.department_metrics(emp(spark, sf), ROLES))

register("performance_distribution", with_emp("""
WITH long AS (
  SELECT 'rating' AS metric, CAST(PerformanceRating AS DOUBLE) AS value FROM emp
  UNION ALL SELECT 'satisfaction', CAST(JobSatisfaction AS DOUBLE) FROM emp
  UNION ALL SELECT 'worklife', CAST(WorkLifeBalance AS DOUBLE) FROM emp),
counts AS (SELECT metric, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
means AS (SELECT metric, round_even(avg(value), 2) AS mean FROM long GROUP BY metric)
SELECT metric, value, n, mean FROM counts JOIN means USING (metric)
"""))(lambda spark, sf: describe.performance_distribution(emp(spark, sf), ROLES))

register("high_low_performers", with_emp(f"""
WITH q AS (SELECT quantile_cont(PerformanceRating, 0.25) AS q25,
                  quantile_cont(PerformanceRating, 0.75) AS q75 FROM emp)
SELECT CAST(q25 AS DOUBLE) AS q25, CAST(q75 AS DOUBLE) AS q75,
  {cnt_if('PerformanceRating >= q75')} AS high_performer_count,
  {pct_sql(cnt_if('PerformanceRating >= q75'), 'count(*)', 1)} AS high_performer_pct,
  {cnt_if('PerformanceRating <= q25')} AS underperformer_count,
  {pct_sql(cnt_if('PerformanceRating <= q25'), 'count(*)', 1)} AS underperformer_pct
FROM emp, q GROUP BY q25, q75
"""))(lambda spark, sf: describe.performer_counts(emp(spark, sf), ROLES))

register("salary_stats", with_emp("""
SELECT round_even(avg(MonthlyIncome), 0) AS mean, round_even(quantile_cont(MonthlyIncome, 0.5), 0) AS median,
  round_even(stddev_samp(MonthlyIncome), 0) AS std, round_even(min(MonthlyIncome), 0) AS min,
  round_even(max(MonthlyIncome), 0) AS max, round_even(quantile_cont(MonthlyIncome, 0.25), 0) AS q25,
  round_even(quantile_cont(MonthlyIncome, 0.75), 0) AS q75
FROM emp
"""))(lambda spark, sf: describe.salary_stats(emp(spark, sf), ROLES))


def _grouped_salary_sql(key: str) -> str:
    return f"""
SELECT {key}, round_even(avg(MonthlyIncome), 0) AS mean, round_even(quantile_cont(MonthlyIncome, 0.5), 0) AS median,
  round_even(stddev_samp(MonthlyIncome), 0) AS std, round_even(min(MonthlyIncome), 0) AS min,
  round_even(max(MonthlyIncome), 0) AS max, round_even(quantile_cont(MonthlyIncome, 0.25), 0) AS q25,
  round_even(quantile_cont(MonthlyIncome, 0.75), 0) AS q75
FROM emp GROUP BY {key}
"""


register("salary_stats_by_department", with_emp(_grouped_salary_sql("Department")))(
    lambda spark, sf: describe.salary_stats(emp(spark, sf), ROLES, by="Department"))
register("salary_stats_by_role", with_emp(_grouped_salary_sql("JobRole")))(
    lambda spark, sf: describe.salary_stats(emp(spark, sf), ROLES, by="JobRole"))

register("pay_by_group", with_emp("""
SELECT 'gender' AS dimension, Gender AS value, round_even(avg(MonthlyIncome), 0) AS avg_income
  FROM emp WHERE Gender IS NOT NULL GROUP BY Gender
UNION ALL SELECT 'department', Department, round_even(avg(MonthlyIncome), 0)
  FROM emp WHERE Department IS NOT NULL GROUP BY Department
UNION ALL SELECT 'job_role', JobRole, round_even(avg(MonthlyIncome), 0)
  FROM emp WHERE JobRole IS NOT NULL GROUP BY JobRole
"""))(lambda spark, sf: describe.pay_by_group(emp(spark, sf), ROLES))


# ---- A11 - A16 -----------------------------------------------------------

def _scores_sql(keys: list[str]) -> str:
    sel = "".join(f"{k}, " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
    join = f"JOIN st USING ({', '.join(keys)})" if keys else ", st"
    risk_parts = ["CASE WHEN r > 10.0 THEN least(100.0, r * 5.0) END",
                  "CASE WHEN sat < 2.5 THEN 70.0 END", "CASE WHEN wlb < 2.5 THEN 60.0 END"]
    risk_sum = " + ".join(f"coalesce({p}, 0.0)" for p in risk_parts)
    risk_n = " + ".join(f"CASE WHEN ({p}) IS NULL THEN 0 ELSE 1 END" for p in risk_parts)
    return with_emp(f"""
WITH s AS (
  SELECT {sel}{rate_sql()} AS r, avg(JobSatisfaction) AS sat, avg(EnvironmentSatisfaction) AS env,
    avg(WorkLifeBalance) AS wlb, avg(JobInvolvement) AS inv, avg(PerformanceRating) AS rat,
    avg(YearsAtCompany) AS ten, avg(TrainingTimesLastYear) AS tr
  FROM emp WHERE {where} {grp}),
d AS (SELECT {sel}Department, {rate_sql()} AS r FROM emp WHERE Department IS NOT NULL AND {where}
      GROUP BY {sel}Department),
st AS (SELECT {sel}round_even(avg(greatest(0.0, 100.0 - r * 3.0)), 1) AS department_stability_score
       FROM d {grp})
SELECT {sel}
  round_even((sat / 4.0 * 100.0 + env / 4.0 * 100.0 + wlb / 4.0 * 100.0
              + least(greatest((rat - 3.0) / 1.0 * 100.0, 0.0), 100.0)
              + greatest(0.0, 100.0 - r * 5.0)) / 5.0, 1) AS workforce_health_score,
  round_even((inv / 4.0 * 100.0 + sat / 4.0 * 100.0 + env / 4.0 * 100.0) / 3.0, 1) AS engagement_score,
  round_even(coalesce(({risk_sum}) / nullif(CAST({risk_n} AS DOUBLE), 0), r * 3.0), 1) AS workforce_risk_index,
  round_even(greatest(0.0, 100.0 - r * 4.0), 1) AS retention_effectiveness,
  round_even((rat / 4.0 * 100.0 + least(ten / 10.0 * 100.0, 100.0) + least(tr / 5.0 * 100.0, 100.0)) / 3.0, 1)
    AS productivity_score,
  department_stability_score
FROM s {join}
""")


register("workforce_scores", _scores_sql([]))(
    lambda spark, sf: scores.workforce_scores(emp(spark, sf), ROLES))
register("scores_by_gender", _scores_sql(["Gender"]))(
    lambda spark, sf: scores.workforce_scores(emp(spark, sf), ROLES, by="Gender"))
register("scores_by_department", _scores_sql(["Department"]))(
    lambda spark, sf: scores.workforce_scores(emp(spark, sf), ROLES, by="Department"))


# ---- R1 - R6, I1 - I6 ------------------------------------------------------

OT_YES = "coalesce(lower(OverTime) IN ('yes', '1', 'true'), false)"

register("recommendations", with_emp(f"""
WITH q AS (SELECT quantile_cont(MonthlyIncome, 0.25) AS q25 FROM emp),
ev AS (
  SELECT count(*) AS n, {rate_sql('MonthlyIncome < q25')} AS low_income_rate,
    {cnt_if('JobSatisfaction <= 2')} AS low_sat_count, {rate_sql(OT_YES)} AS overtime_rate,
    {rate_sql('YearsSinceLastPromotion > 5')} AS no_promo_rate
  FROM emp, q),
d AS (SELECT Department, {rate_sql()} AS r FROM emp WHERE Department IS NOT NULL GROUP BY Department),
fired AS (
  SELECT 1 AS rule_no, 'Department Risk' AS category, 'High' AS priority, Department AS target,
         r AS metric_value, CAST(NULL AS BIGINT) AS employees FROM d WHERE r > 20.0
  UNION ALL SELECT 2, 'Compensation', 'High', 'Low-income employees', low_income_rate, NULL
    FROM ev WHERE low_income_rate > 15.0
  UNION ALL SELECT 3, 'Employee Satisfaction', 'Medium', 'Low satisfaction employees',
    {pct_sql('low_sat_count', 'n')}, low_sat_count FROM ev WHERE low_sat_count > n * CAST(0.15 AS DOUBLE)
  UNION ALL SELECT 4, 'Workload Management', 'High', 'Overtime employees', overtime_rate, NULL
    FROM ev WHERE overtime_rate > 20.0
  UNION ALL SELECT 5, 'Career Growth', 'Medium', 'Long-tenure without promotion', no_promo_rate, NULL
    FROM ev WHERE no_promo_rate > 15.0)
SELECT * FROM fired
UNION ALL SELECT 6, 'General', 'Low', 'All employees', NULL, NULL WHERE (SELECT count(*) FROM fired) = 0
"""))(lambda spark, sf: findings.recommendations(emp(spark, sf), ROLES).select(
    "rule_no", "category", "priority", "target", "metric_value", "employees"))

register("insights", with_emp(f"""
WITH q AS (SELECT quantile_cont(MonthlyIncome, 0.5) AS med FROM emp),
ev AS (
  SELECT {rate_sql(OT_YES)} AS ot, {rate_sql('NOT ' + OT_YES)} AS no_ot,
    {rate_sql('MonthlyIncome < med')} AS lo_inc, {rate_sql('MonthlyIncome >= med')} AS hi_inc,
    {rate_sql('JobSatisfaction <= 2')} AS lo_sat, {rate_sql('JobSatisfaction >= 4')} AS hi_sat,
    avg(Age) AS age
  FROM emp, q),
m AS (SELECT Department, avg(MonthlyIncome) AS m FROM emp WHERE Department IS NOT NULL GROUP BY Department),
g AS (SELECT (max(m) - min(m)) / avg(m) * 100.0 AS gap FROM m)
SELECT 1 AS rule_no, 'Attrition Driver' AS type, 'High' AS severity, ot AS metric_value, no_ot AS compare_value
  FROM ev WHERE ot > no_ot * 1.5
UNION ALL SELECT 2, 'Compensation Risk', 'High', lo_inc, hi_inc FROM ev WHERE lo_inc > hi_inc * 1.5
UNION ALL SELECT 3, 'Satisfaction Risk', 'Critical', lo_sat, hi_sat FROM ev WHERE lo_sat > hi_sat * 2.0
UNION ALL SELECT 4, 'Pay Equity', 'Medium', round_even(gap, 2), NULL FROM g WHERE gap > 30.0
UNION ALL SELECT 5, 'Aging Workforce', 'Medium', round_even(age, 1), NULL FROM ev WHERE age > 45.0
UNION ALL SELECT 6, 'Young Workforce', 'Low', round_even(age, 1), NULL FROM ev WHERE age < 28.0
"""))(lambda spark, sf: findings.insights(emp(spark, sf), ROLES).select(
    "rule_no", "type", "severity", "metric_value", "compare_value"))


# ---- A17, A24, A25, A27 --------------------------------------------------

register("attrition_crosstab", with_emp(f"""
WITH cells AS (SELECT Department AS department, JobRole AS job_role, count(*) AS employees, {rate_sql()} AS attrition_pct
  FROM emp WHERE Department IS NOT NULL AND JobRole IS NOT NULL GROUP BY Department, JobRole)
SELECT department, job_role, coalesce(employees, 0) AS employees, coalesce(attrition_pct, 0.0) AS attrition_pct
FROM (SELECT DISTINCT department FROM cells) CROSS JOIN (SELECT DISTINCT job_role FROM cells)
LEFT JOIN cells USING (department, job_role)
"""))(lambda spark, sf: describe.attrition_crosstab(emp(spark, sf), ROLES))

register("department_pay_gap", with_emp("""
WITH m AS (SELECT Department, avg(MonthlyIncome) AS m FROM emp WHERE Department IS NOT NULL GROUP BY Department)
SELECT first(Department ORDER BY m DESC, Department) AS max_department, round_even(max(m), 0) AS max_avg_income,
  first(Department ORDER BY m ASC, Department) AS min_department, round_even(min(m), 0) AS min_avg_income,
  round_even((max(m) - min(m)) / avg(m) * 100.0, 2) AS pay_gap_pct
FROM m
"""))(lambda spark, sf: describe.department_pay_gap(emp(spark, sf), ROLES))


def _hist_sql(col: str, bins: int) -> str:
    return with_emp(f"""
WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM emp WHERE {col} IS NOT NULL),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {float(bins)})), {bins - 1}) END
             AS INTEGER) AS bin, lo, hi FROM v, mm)
SELECT bin, round_even(lo + bin * (hi - lo) / {bins}, 4) AS bin_lo,
  round_even(lo + (bin + 1) * (hi - lo) / {bins}, 4) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi
""")


for _role, _col, _bins in (("income", "MonthlyIncome", 30), ("age", "Age", 20), ("tenure", "YearsAtCompany", 15)):
    register(f"histogram_{_role}", _hist_sql(_col, _bins))(
        lambda spark, sf, _r=_role, _b=_bins: describe.role_histogram(emp(spark, sf), ROLES, _r, _b))

register("satisfaction_levels", with_emp("""
WITH long AS (
  SELECT 'JobSatisfaction' AS c, JobSatisfaction AS level FROM emp
  UNION ALL SELECT 'EnvironmentSatisfaction', EnvironmentSatisfaction FROM emp
  UNION ALL SELECT 'WorkLifeBalance', WorkLifeBalance FROM emp
  UNION ALL SELECT 'JobInvolvement', JobInvolvement FROM emp)
SELECT replace(replace(c, 'Satisfaction', ' Sat'), 'Balance', ' Balance') AS series, CAST(level AS INTEGER) AS level,
  'Level ' || CAST(level AS VARCHAR) AS label, count(*) AS n
FROM long WHERE level IS NOT NULL GROUP BY c, level
"""))(lambda spark, sf: describe.satisfaction_levels(emp(spark, sf), ROLES))


# ---- A19 - A22 -----------------------------------------------------------

NUMERIC = ["EducationLevel", "Age", "MonthlyIncome", "YearsAtCompany", "YearsSinceLastPromotion",
           "NumCompaniesWorked", "TrainingTimesLastYear", "JobSatisfaction", "EnvironmentSatisfaction",
           "WorkLifeBalance", "JobInvolvement", "PerformanceRating"]
TEXT = ["EmployeeID", "Gender", "Department", "JobRole", "Education", "OverTime", "Attrition"]
ALL_COLUMNS = ["EmployeeID", "Gender", "Department", "JobRole", "Education", "EducationLevel", "Age",
               "MonthlyIncome", "YearsAtCompany", "YearsSinceLastPromotion", "NumCompaniesWorked",
               "TrainingTimesLastYear", "JobSatisfaction", "EnvironmentSatisfaction", "WorkLifeBalance",
               "JobInvolvement", "PerformanceRating", "OverTime", "Attrition"]
SPARK_TYPES = {c: "string" for c in TEXT} | {c: "int" for c in NUMERIC} | {"MonthlyIncome": "double"}


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(NUMERIC):
        for b in NUMERIC[i:]:
            xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            r = f"covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, round_even({r}, 6) AS r FROM emp")
            if a != b:
                parts.append(f"SELECT '{b}' AS x, '{a}' AS y, round_even({r}, 6) AS r FROM emp")
    return with_emp("\nUNION ALL ".join(parts))


register("correlation_matrix", _corr_sql())(
    lambda spark, sf: profile.correlation_matrix(emp(spark, sf), NUMERIC))

register("profile_nulls", with_emp("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS position, '{SPARK_TYPES[c]}' AS dtype, {cnt_if(c + ' IS NULL')} AS null_count, "
    f"{pct_sql(cnt_if(c + ' IS NULL'), 'count(*)')} AS null_pct, count(*) AS rows, {len(ALL_COLUMNS)} AS columns FROM emp"
    for i, c in enumerate(ALL_COLUMNS))))(lambda spark, sf: profile.null_profile(emp(spark, sf)))

register("profile_numeric", with_emp("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round_even(avg(CAST({c} AS DOUBLE)), 2) AS mean, "
    f"round_even(stddev_samp(CAST({c} AS DOUBLE)), 2) AS std, round_even(min(CAST({c} AS DOUBLE)), 2) AS min, "
    f"round_even(max(CAST({c} AS DOUBLE)), 2) AS max, "
    f"round_even(quantile_cont(CAST({c} AS DOUBLE), 0.5), 2) AS median FROM emp" for c in NUMERIC)))(
    lambda spark, sf: profile.numeric_profile(emp(spark, sf), NUMERIC))

register("profile_categorical", with_emp("""
WITH long AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM emp" for c in TEXT) + """),
counts AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL),
uniq AS (SELECT "column", count(*) AS unique_count FROM counts GROUP BY "column"),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank
           FROM counts)
SELECT "column", unique_count, rank, value, n FROM ranked JOIN uniq USING ("column") WHERE rank <= 5
"""))(lambda spark, sf: profile.categorical_profile(emp(spark, sf), TEXT))


# ---- W1 ------------------------------------------------------------------

# K3 by verified candidates: a flag, keys of many values and one of near-unique values.
_TOP = ["l_returnflag", "l_partkey", "l_suppkey", "l_orderkey"]
register("top_values", """
WITH long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM lineitem" for c in _TOP) + """),
counts AS (SELECT "column", value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", CAST(rank AS INTEGER) AS rank, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM counts) WHERE rank <= 5
""")(lambda spark, sf: heavy.top_values(table(spark, sf, "lineitem"), _TOP))


# A3 by sketches: states of every event type, united; the exact counts lie within the stated bounds.
_COUNTED = ["user_id", "props", "event_id"]


def _sketched(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    near = sketches.distinct_counts(sketches.distinct_states(events, _COUNTED, "event_type"))
    exact = events.agg(*[F.count_distinct(c).alias(c) for c in _COUNTED]).select(F.explode(F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_exact")) for c in _COUNTED])).alias("s")).select("s.*")
    return near.join(exact, "column").select("column", "n", "n_exact", F.col("n_exact").between(F.col("low"), F.col("high")).alias("within"))


register("distinct_sketches", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_exact, true AS within FROM events" for c in _COUNTED))(_sketched)


def _log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The events as log rows, appended in two writes by event type and once more under the same ids, with a write
    that is never committed between; then read back."""
    import uuid

    from hrsight.session import scratch_path
    from hrsight.sources import logs
    path = scratch_path(spark, f"log-roundtrip-{uuid.uuid4().hex}")
    events = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), "user_id", F.col("event_type").alias("action"),
        F.lit("events").alias("dataset_name"), F.col("props").alias("details"), F.col("ts").cast("timestamp").alias("timestamp"))
    for turn in range(2):
        for part in (0, 1):
            logs.append_once(events.where(F.pmod(F.xxhash64("action"), F.lit(2)) == part), path, f"part-{part}")
        if turn == 0:
            events.write.parquet(f"{path}/attempt={uuid.uuid4().hex}")
    return logs.read_log(spark, path).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("user_id").alias("users"),
        F.count("details").alias("with_details"))


register("log_roundtrip", """
SELECT event_type AS action, count(*) AS n, count(DISTINCT event_id) AS ids, count(DISTINCT user_id) AS users,
  count(props) AS with_details FROM events GROUP BY event_type
""")(_log_roundtrip)


def _projection_sql(keys: list[str], periods: int = 12, noise_sd: float = 0.0, seed: int = 42) -> str:
    noise = "" if not noise_sd else " + " + draws.normal("u", 0.0, noise_sd)
    u = draws.uniform(projection.noise_key(keys).replace("`", ""), projection.NOISE_STREAM, seed, draws.DUCKDB)
    sel = "".join(f"{k}, " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    where = " AND ".join(f"{k} IS NOT NULL" for k in keys) or "true"
    return with_emp(f"""
WITH s AS (SELECT {sel}count(*) AS n0, {rate_sql()} AS r0 FROM emp WHERE {where} {grp}),
t AS (SELECT {sel}n0, r0, month, {u} AS u FROM s, (SELECT CAST(month AS INTEGER) AS month FROM range(1, {periods + 1}) t(month))),
m AS (SELECT {sel}n0, r0, month,
        CAST(floor(n0 * 0.02 / 12.0) AS BIGINT) AS step,
        least(greatest(greatest(5.0, r0 * pow(0.98, CAST(month AS DOUBLE)){noise}), 0.0), 50.0) AS r
      FROM t),
d AS (SELECT *, CAST(floor((n0 + (month - 1) * step) * r / 100.0 / 12.0) AS BIGINT) AS dep FROM m)
SELECT {sel}month, round_even(r, 2) AS projected_attrition_rate, dep AS projected_departures,
  n0 + month * step AS projected_size, dep + step AS hiring_needed
FROM d
""")


register("projection", _projection_sql([]))(
    lambda spark, sf: projection.projection(emp(spark, sf), ROLES))
register("projection_by_department", _projection_sql(["Department"]))(
    lambda spark, sf: projection.projection(emp(spark, sf), ROLES, by="Department"))
register("projection_noise", _projection_sql([], 60, 0.5))(
    lambda spark, sf: projection.projection(emp(spark, sf), ROLES, periods=60, noise_sd=0.5))
register("projection_noise_by_group", _projection_sql(["Department", "JobRole"], 24, 2.5, 7))(
    lambda spark, sf: projection.projection(emp(spark, sf), ROLES, ["Department", "JobRole"], 24, 2.5, 7))


# ---- P13 - P15 -----------------------------------------------------------

SEARCH_TERM = "emp_12"

register("preview", with_emp("SELECT * FROM emp ORDER BY EmployeeID LIMIT 50"))(
    lambda spark, sf: lookup.preview(emp(spark, sf), ROLES, 50))
register("employee_search", with_emp(
    f"SELECT * FROM emp WHERE contains(lower(EmployeeID), '{SEARCH_TERM}') ORDER BY EmployeeID LIMIT 20"))(
    lambda spark, sf: lookup.employee_search(emp(spark, sf), SEARCH_TERM, ROLES))
register("department_search", with_emp(
    "SELECT DISTINCT Department AS department FROM emp WHERE Department IS NOT NULL "
    "AND contains(lower(Department), 'ur')"))(
    lambda spark, sf: lookup.department_search(emp(spark, sf), "UR", ROLES))


# ---- P16: row numbers and ids of a frame without an id ---------------------

#: Columns of the view that repeat in many rows, and all of text or integers (one text in both engines).
INDEXED = ["Gender", "Department", "JobRole", "Age", "NumCompaniesWorked", "OverTime"]
_INDEX_SQL = f"""
SELECT row_number() OVER (ORDER BY md5(concat({", ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)) END"
    for c in INDEXED)}))) - 1 AS "index", {", ".join(INDEXED)} FROM emp
"""
register("employee_index", with_emp(_INDEX_SQL))(
    lambda spark, sf: rowindex.with_index(emp(spark, sf).select(*INDEXED)))
register("employee_fallback_ids", with_emp(
    f"SELECT *, concat('Employee_', CAST(\"index\" AS VARCHAR)) AS employee_id FROM ({_INDEX_SQL})"))(
    lambda spark, sf: lookup.with_employee_id(emp(spark, sf).select(*INDEXED), ROLES))


# ---- K8 / P17 on the events table -----------------------------------------

register("activity_latest", """
SELECT user_id, CAST(rank AS INTEGER) AS rank, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
WHERE rank <= 5
""")(lambda spark, sf: activity.latest_per_user(
    table(spark, sf, "events"), 5, ts_col="ts", tie_col="event_id")
    .select("user_id", "rank", "event_id", "ts", "event_type"))

register("activity_user_history", """
SELECT event_id, ts, user_id, event_type FROM events
WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100
""")(lambda spark, sf: activity.history(
    table(spark, sf, "events"),
    table(spark, sf, "events").agg(F.min("user_id")).scalar(), 100, ts_col="ts", tie_col="event_id")
    .select("event_id", "ts", "user_id", "event_type"))


# ---- M1 - M17: models ----------------------------------------------------
# Training is iterative (no SQL equivalent): the model queries have no
# oracle. Queries after each other in one session and folder share a training
# run; only the last one is kept. Cross-validation doesn't change the models,
# so only the query that shows its figures runs it.

_TRAINED: dict = {}


def trained(spark: SparkSession, sf: str, cv_folds: int = 0):
    from hrsight.ml import train
    key = (spark.sparkContext.applicationId, sf)
    folds, result = _TRAINED.get(key, (None, None))
    if folds is None or folds < cv_folds:
        for _, old in _TRAINED.values():
            old.release()
        _TRAINED.clear()
        result = train.train_models(emp(spark, sf), ROLES, settings=train.DEFAULT, cv_folds=cv_folds)
        _TRAINED[key] = cv_folds, result
    return result


def _ml(fn, cv_folds: int = 0):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fn(spark, sf, trained(spark, sf, cv_folds))
    return run


register("class_weights", with_emp(f"""
WITH l AS (SELECT CASE WHEN {LEFT} THEN 1.0 ELSE 0.0 END AS label FROM emp WHERE Attrition IS NOT NULL),
c AS (SELECT label, count(*) AS n_c FROM l GROUP BY label)
SELECT label, n_c, CAST((SELECT sum(n_c) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n_c) AS class_weight FROM c
"""))(lambda spark, sf: _prep().class_weights(_prep().labelled(emp(spark, sf), ROLES)))


def _prep():
    from hrsight.ml import prep
    return prep


def _split_counts(spark: SparkSession, sf: str) -> DataFrame:
    prep = _prep()
    data = prep.row_key(prep.labelled(emp(spark, sf), ROLES), ROLES)
    train, test = prep.split(data)
    return (train.select(F.lit("train").alias("split"), "label", "fold")
            .unionByName(test.select(F.lit("test").alias("split"), "label", F.lit(None).cast("int").alias("fold")))
            .groupBy("split", "label", "fold").agg(F.count(F.lit(1)).alias("n")))


register("ml_split_counts")(_split_counts)
register("ml_metrics")(_ml(lambda spark, sf, r: r.results, cv_folds=5))
register("ml_feature_importance")(_ml(lambda spark, sf, r: __import__(
    "hrsight.ml.train", fromlist=["x"]).feature_importance(r, top=15)))
register("ml_model_comparison")(_ml(lambda spark, sf, r: __import__(
    "hrsight.ml.train", fromlist=["x"]).model_comparison(r)))
register("ml_roc")(_ml(lambda spark, sf, r: __import__("hrsight.ml.train", fromlist=["x"]).roc_curves(r)))


def _scores_frame(spark, sf, r, counted=True):
    from hrsight.ml import score
    return score.predict_with(r, emp(spark, sf), ROLES, index=counted)


register("ml_risk_distribution")(_ml(lambda spark, sf, r: __import__(
    "hrsight.ml.score", fromlist=["x"]).risk_distribution(_scores_frame(spark, sf, r, False))))
register("ml_top_risk")(_ml(lambda spark, sf, r: __import__(
    "hrsight.ml.score", fromlist=["x"]).top_risk(_scores_frame(spark, sf, r), 100)))

# M14, M15, A23 by a compiled model: a boosted ensemble fitted on this view at
# sf0.01 (10 rounds, depth 3; ml/scorecard.json), run as SQL text on
# both sides.

@functools.cache
def scorecard():
    from hrsight.ml import compiled
    with open(os.path.join(os.path.dirname(compiled.__file__), "scorecard.json"), encoding="utf-8") as f:
        return compiled.Scorecard.from_json(f.read())


def _compiled_risk(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.ml import compiled, score
    rows = compiled.score(emp(spark, sf), scorecard(), ["EmployeeID"], "p").withColumn("prediction", (F.col("p") > 0.5).cast("double"))
    return score.risk_columns(rows, F.col("p"), keys=["EmployeeID"])


_COMPILED_SQL = f"""
WITH p AS ({scorecard().sql("emp", ["EmployeeID"], "duckdb", "p")}),
scored AS (SELECT EmployeeID, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN p > 0.5 THEN 'Yes' ELSE 'No' END AS predicted_label,
  CASE WHEN p >= 0.7 THEN 'High Risk' WHEN p >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level, p FROM p)
"""
register("ml_compiled_scores", with_emp(_COMPILED_SQL + """
SELECT EmployeeID, prediction, predicted_label, risk_level, round_even(p, 6) AS probability FROM scored
"""))(lambda spark, sf: _compiled_risk(spark, sf).select(
    "EmployeeID", "prediction", "predicted_label", "risk_level", F.bround("probability", 6).alias("probability")))
register("ml_compiled_risk_distribution", with_emp(_COMPILED_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE risk_level = 'Low Risk') AS low_risk_count,
  count(*) FILTER (WHERE risk_level = 'Medium Risk') AS medium_risk_count,
  count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_count FROM scored
"""))(lambda spark, sf: __import__("hrsight.ml.score", fromlist=["x"]).risk_distribution(_compiled_risk(spark, sf)))

# Metric formulas (M10) on a fixed rule score, checked against SQL.
_FIXED_SCORE_SQL = (f"round_even((CASE WHEN {OT_YES} THEN 40 ELSE 0 END"
                    " + CASE WHEN coalesce(JobSatisfaction <= 2, false) THEN 35 ELSE 0 END"
                    " + CASE WHEN coalesce(MonthlyIncome < 1200, false) THEN 20 ELSE 0 END"
                    " + CASE WHEN coalesce(YearsSinceLastPromotion > 5, false) THEN 5 ELSE 0 END) / 100.0, 2)")


def _fixed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.ml import evaluate
    sc = emp(spark, sf).selectExpr(f"{_FIXED_SCORE_SQL.replace('round_even', 'bround')} AS p_left",
                                   f"CASE WHEN {LEFT} THEN 1.0 ELSE 0.0 END AS label")
    sc = sc.withColumn("prediction", (F.col("p_left") >= 0.5).cast("double"))
    m = evaluate.metrics_from_confusion(evaluate.confusion(sc))
    a = evaluate.auc(sc)
    return m.select(*[F.bround(c, 6).alias(c) for c in m.columns],
                    F.bround(F.lit(a).cast("double"), 6).alias("roc_auc"))


register("ml_metrics_fixed_score", with_emp(f"""
WITH sc AS (SELECT {_FIXED_SCORE_SQL} AS s, CASE WHEN {LEFT} THEN 1.0 ELSE 0.0 END AS y FROM emp),
p AS (SELECT y, CASE WHEN s >= 0.5 THEN 1.0 ELSE 0.0 END AS yhat FROM sc),
c AS (SELECT count(*) AS total, sum(CASE WHEN y = yhat THEN 1 ELSE 0 END) AS correct,
        sum(CASE WHEN y = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS tp1, sum(CASE WHEN y = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS tp0,
        sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS a1, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS a0,
        sum(CASE WHEN yhat = 1 THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN yhat = 0 THEN 1 ELSE 0 END) AS p0 FROM p),
r AS (SELECT *, coalesce(tp1 / nullif(CAST(p1 AS DOUBLE), 0), 0.0) AS pr1, coalesce(tp0 / nullif(CAST(p0 AS DOUBLE), 0), 0.0) AS pr0,
        coalesce(tp1 / nullif(CAST(a1 AS DOUBLE), 0), 0.0) AS rc1, coalesce(tp0 / nullif(CAST(a0 AS DOUBLE), 0), 0.0) AS rc0,
        a1 / CAST(total AS DOUBLE) AS w1, a0 / CAST(total AS DOUBLE) AS w0 FROM c),
per AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY s),
cum AS (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per),
a AS (SELECT sum(pos * (nb + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc FROM cum)
SELECT round_even(correct / CAST(total AS DOUBLE), 6) AS accuracy,
  round_even(w0 * pr0 + w1 * pr1, 6) AS precision, round_even(w0 * rc0 + w1 * rc1, 6) AS recall,
  round_even(w0 * coalesce(2.0 * pr0 * rc0 / nullif(pr0 + rc0, 0), 0.0) + w1 * coalesce(2.0 * pr1 * rc1 / nullif(pr1 + rc1, 0), 0.0), 6) AS f1_score,
  round_even(auc, 6) AS roc_auc
FROM r, a
"""))(_fixed_metrics)


# ---- S5 / S6: synthetic rows keyed by the order keys -----------------------

def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return synthetic.refine_labels(synthetic.generate(ids))


register("synthetic_rows", f"""
WITH g AS ({synthetic.generate_sql("SELECT o_orderkey AS _id FROM orders")}),
q AS (SELECT quantile_cont(MonthlyIncome, 0.25) AS q25 FROM g),
r AS (SELECT g.*, {draws.uniform("CAST(_id AS STRING)", synthetic.FLIP_STREAM, 42, draws.DUCKDB)} AS u,
  CASE WHEN JobSatisfaction <= 2 THEN 30 ELSE 0 END + CASE WHEN OverTime = 'Yes' THEN 20 ELSE 0 END
  + CASE WHEN YearsSinceLastPromotion > 5 THEN 15 ELSE 0 END + CASE WHEN MonthlyIncome < q25 THEN 15 ELSE 0 END
  + CASE WHEN WorkLifeBalance <= 2 THEN 10 ELSE 0 END + CASE WHEN EnvironmentSatisfaction <= 2 THEN 10 ELSE 0 END AS risk FROM g, q)
SELECT * EXCLUDE (u, risk) REPLACE (CASE WHEN risk > 40 AND Attrition = 'No' AND u < risk / 100.0 THEN 'Yes'
  WHEN risk < 10 AND Attrition = 'Yes' AND u < 0.5 THEN 'No' ELSE Attrition END AS Attrition) FROM r
""")(_synthetic)

register("synthetic_label_rule", with_emp("""
WITH q AS (SELECT quantile_cont(MonthlyIncome, 0.25) AS q25 FROM emp),
s AS (SELECT EmployeeID, Attrition,
  CASE WHEN coalesce(JobSatisfaction <= 2, false) THEN 30 ELSE 0 END + CASE WHEN coalesce(OverTime = 'Yes', false) THEN 20 ELSE 0 END
  + CASE WHEN coalesce(YearsSinceLastPromotion > 5, false) THEN 15 ELSE 0 END + CASE WHEN coalesce(MonthlyIncome < q25, false) THEN 15 ELSE 0 END
  + CASE WHEN coalesce(WorkLifeBalance <= 2, false) THEN 10 ELSE 0 END
  + CASE WHEN coalesce(EnvironmentSatisfaction <= 2, false) THEN 10 ELSE 0 END AS risk FROM emp, q)
SELECT EmployeeID, risk, risk > 40 AND Attrition = 'No' AS may_flip_to_yes,
  risk < 10 AND Attrition = 'Yes' AS may_flip_to_no FROM s
"""))(lambda spark, sf: _label_rule(spark, sf))


def _label_rule(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.functions.quantiles import exact_quantile
    e = emp(spark, sf)
    risk = synthetic.risk_hundredths(e, exact_quantile(e, "MonthlyIncome", 0.25))
    return e.select("EmployeeID", risk.alias("risk"), "Attrition").select(
        "EmployeeID", "risk",
        ((F.col("risk") > synthetic.FLIP_UP_ABOVE) & (F.col("Attrition") == "No")).alias("may_flip_to_yes"),
        ((F.col("risk") < synthetic.FLIP_DOWN_BELOW) & (F.col("Attrition") == "Yes")).alias("may_flip_to_no"))


# ---- S1 - S4, S7 - S9 ------------------------------------------------------

def _csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write the view as CSV into the shared folder, validate it, read it back
    with inference, and sum up what was read."""
    import uuid

    from hrsight.session import scratch_path
    from hrsight.sources import csv
    path = scratch_path(spark, f"csv-roundtrip-{uuid.uuid4().hex}")
    csv.write_employees(emp(spark, sf), path)
    failed = csv.validate(spark, path).where("NOT ok").count()
    back = csv.read_employees(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("EmployeeID").alias("ids"), F.sum("Age").cast("bigint").alias("sum_age"),
        F.count("OverTime").alias("with_overtime"), F.count("MonthlyIncome").alias("with_income"),
        F.min("MonthlyIncome").alias("min_income"), F.max("MonthlyIncome").alias("max_income"),
        F.max("Department").alias("last_department"), F.lit(failed).cast("bigint").alias("failed_checks"))


register("csv_roundtrip", with_emp("""
SELECT count(*) AS n, count(DISTINCT EmployeeID) AS ids, CAST(sum(Age) AS BIGINT) AS sum_age, count(OverTime) AS with_overtime,
  count(MonthlyIncome) AS with_income, min(MonthlyIncome) AS min_income, max(MonthlyIncome) AS max_income,
  max(Department) AS last_department, CAST(0 AS BIGINT) AS failed_checks FROM emp
"""))(_csv_roundtrip)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.plans.report import report_sections
    return report_sections(emp(spark, sf), ROLES)


def _text_report(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.plans.report import report_sections, text_lines
    return text_lines(report_sections(emp(spark, sf), ROLES))


register("report_sections")(_report)
register("report_text_lines")(_text_report)


# ---- segment variants (by=) ------------------------------------------------

register("overview_by_gender", with_emp(f"""
SELECT Gender, count(*) AS total_employees, count(DISTINCT Department) AS total_departments,
  count(DISTINCT JobRole) AS total_job_roles, round_even(avg(Age), 1) AS avg_age,
  round_even(avg(MonthlyIncome), 0) AS avg_income, round_even(avg(YearsAtCompany), 1) AS avg_tenure,
  {rate_sql()} AS attrition_rate
FROM emp GROUP BY Gender
"""))(lambda spark, sf: describe.overview(emp(spark, sf), ROLES, by="Gender"))

register("distribution_department_by_gender", with_emp(f"""
SELECT Gender, value, n, {pct_sql('n', 'sum(n) OVER (PARTITION BY Gender)')} AS share_pct FROM (
  SELECT Gender, Department AS value, count(*) AS n FROM emp WHERE Department IS NOT NULL GROUP BY Gender, Department)
"""))(lambda spark, sf: describe.role_distribution(emp(spark, sf), ROLES, "department", by="Gender"))


# ---- forms of the operators above that their own query leaves out ----------

def _fixed_scored(spark: SparkSession, sf: str) -> DataFrame:
    sc = emp(spark, sf).selectExpr("EmployeeID AS employee_id", f"CAST({_FIXED_SCORE_SQL.replace('round_even', 'bround')} AS DOUBLE) AS p_left",
                                   f"CASE WHEN {LEFT} THEN 1.0 ELSE 0.0 END AS label")
    return sc.withColumn("prediction", (F.col("p_left") >= 0.5).cast("double"))


def _fixed_risk(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.ml import score
    return score.risk_columns(_fixed_scored(spark, sf), F.col("p_left"), ("stayed", "left"))


def _fixed_roc(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.ml import evaluate
    pts = evaluate.roc_points(_fixed_scored(spark, sf)).where(F.col("threshold") < float("inf"))
    return pts.select("threshold", F.bround("fpr", 6).alias("fpr"), F.bround("tpr", 6).alias("tpr"))


_FIXED_SQL = f"sc AS (SELECT EmployeeID, {_FIXED_SCORE_SQL} AS s, CASE WHEN {LEFT} THEN 1.0 ELSE 0.0 END AS y FROM emp)"
_FIXED_RISK_SQL = f"""{_FIXED_SQL}, risk AS (SELECT EmployeeID AS employee_id, CAST(s >= 0.5 AS INTEGER) AS prediction,
  CASE WHEN s >= 0.5 THEN 'left' ELSE 'stayed' END AS predicted_label, round_even(CAST(s AS DOUBLE), 4) AS attrition_probability,
  CASE WHEN s >= 0.7 THEN 'High Risk' WHEN s >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level,
  round_even(s * 100.0, 1) AS risk_score, round_even(greatest(s, 1.0 - s), 4) AS confidence, s FROM sc)"""

register("ml_roc_fixed_score", with_emp(f"""
WITH {_FIXED_SQL}, per AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY s)
SELECT s AS threshold, round_even(sum(neg) OVER w / (SELECT sum(neg) FROM per), 6) AS fpr,
  round_even(sum(pos) OVER w / (SELECT sum(pos) FROM per), 6) AS tpr
FROM per WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""))(_fixed_roc)

register("ml_risk_distribution_fixed_score", with_emp(f"""
WITH {_FIXED_RISK_SQL}
SELECT count(*) AS total, {cnt_if("risk_level = 'Low Risk'")} AS low_risk_count,
  {cnt_if("risk_level = 'Medium Risk'")} AS medium_risk_count, {cnt_if("risk_level = 'High Risk'")} AS high_risk_count FROM risk
"""))(lambda spark, sf: __import__("hrsight.ml.score", fromlist=["x"]).risk_distribution(_fixed_risk(spark, sf)))

register("ml_top_risk_fixed_score", with_emp(f"""
WITH {_FIXED_RISK_SQL} SELECT * EXCLUDE (s) FROM risk ORDER BY s DESC, employee_id LIMIT 100
"""))(lambda spark, sf: __import__("hrsight.ml.score", fromlist=["x"]).top_risk(_fixed_risk(spark, sf), 100))

register("projection_series", f"""
WITH p AS ({_projection_sql([])}), x AS (SELECT *, 'M' || CAST(month AS VARCHAR) AS x FROM p)
SELECT 'Attrition %' AS series, x, month, CAST(projected_attrition_rate AS DOUBLE) AS y FROM x
UNION ALL SELECT 'Workforce Size', x, month, CAST(projected_size AS DOUBLE) FROM x
""")(lambda spark, sf: projection.projection_series(projection.projection(emp(spark, sf), ROLES)))

_SHOWN = ["EmployeeID", "Gender", "Department", "Age", "OverTime", "NumCompaniesWorked"]
register("preview_text", with_emp(
    "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _SHOWN) + " FROM emp ORDER BY emp.EmployeeID LIMIT 50"))(
    lambda spark, sf: lookup.preview(emp(spark, sf).select(*_SHOWN), ROLES, 50, as_text=True))

register("employee_search_regex", with_emp(
    "SELECT * FROM emp WHERE regexp_matches(lower(EmployeeID), '_1[0-3]*7$') ORDER BY EmployeeID LIMIT 20"))(
    lambda spark, sf: lookup.employee_search(emp(spark, sf), "_1[0-3]*7$", ROLES, regex=True))

# Thresholds at which the rules that the view never triggers fire.
_QUIET = {"dept_rate": 101.0, "low_income_rate": 101.0, "low_sat_share": 1.1, "overtime_rate": 101.0, "promo_rate": 101.0}
register("recommendations_quiet", "SELECT 6 AS rule_no, 'General' AS category, 'Low' AS priority, 'All employees' AS target")(
    lambda spark, sf: findings.recommendations(emp(spark, sf), ROLES, **_QUIET).select("rule_no", "category", "priority", "target"))

_LOUD = {"overtime_ratio": 1e9, "income_ratio": 1e9, "sat_ratio": 1e9, "pay_gap_pct": -1.0, "age_old": 0.0, "age_young": 200.0}
register("insights_workforce", with_emp("""
WITH m AS (SELECT Department, avg(MonthlyIncome) AS m FROM emp WHERE Department IS NOT NULL GROUP BY Department)
SELECT 4 AS rule_no, 'Pay Equity' AS type, 'Medium' AS severity,
  round_even((max(m) - min(m)) / avg(m) * 100.0, 2) AS metric_value FROM m
UNION ALL SELECT 5, 'Aging Workforce', 'Medium', round_even(avg(Age), 1) FROM emp
UNION ALL SELECT 6, 'Young Workforce', 'Low', round_even(avg(Age), 1) FROM emp
"""))(lambda spark, sf: findings.insights(emp(spark, sf), ROLES, **_LOUD).where("rule_no > 3").select(
    "rule_no", "type", "severity", "metric_value"))


def _report_values(spark: SparkSession, sf: str) -> DataFrame:
    from hrsight.plans.report import report_sections
    return report_sections(emp(spark, sf), ROLES).where("section = 'overview'").select(
        "section", "key", "label", F.col("value").cast("double").alias("value"))


_OVERVIEW = ["total_employees", "total_departments", "total_job_roles", "avg_age", "avg_income", "avg_tenure", "attrition_rate"]
register("report_overview_values", f"WITH o AS ({ORACLES['overview']})\n" + "\nUNION ALL ".join(
    f"SELECT 'overview' AS section, '{k}' AS \"key\", '{k.replace('_', ' ').title()}' AS label, CAST({k} AS DOUBLE) AS value FROM o"
    for k in _OVERVIEW))(_report_values)
