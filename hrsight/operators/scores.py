"""Composite workforce scores (health, engagement, stability, risk,
retention, productivity).

All inputs come from one aggregate per (group, department), one scan; the
formulas are then plain column arithmetic on the (per-group) stats row. A score averages
only the parts whose columns exist; a part whose mean is NULL (all values
missing) is left out of the average.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrsight.functions.exprs import clamp, col, count_if, group_cols, label_flag, mean_of, pct, rnd
from hrsight.roles import Roles

# Score weights and thresholds.
RETENTION_PENALTY = 5.0      # health: max(0, 100 - 5 * rate)
STABILITY_PENALTY = 3.0      # stability: max(0, 100 - 3 * department rate)
RETENTION_EFF_PENALTY = 4.0  # retention effectiveness: max(0, 100 - 4 * rate)
RISK_RATE_MIN = 10.0         # risk part 1 fires above this rate: min(100, 5 * rate)
RISK_SAT_LOW, RISK_SAT_PART = 2.5, 70.0
RISK_WLB_LOW, RISK_WLB_PART = 2.5, 60.0
RISK_FALLBACK_FACTOR = 3.0   # no part fired: 3 * rate
TENURE_FULL, TRAINING_FULL = 10.0, 5.0


MEANS = ("satisfaction", "environment", "worklife", "involvement", "rating", "tenure", "training", "age")


def stats(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None) -> DataFrame:
    """One row per group: headcount, attrition rate, the means the scores use, and the stability score.

    One aggregation per (group, department) reads the data; everything else is
    derived from that small frame."""
    roles = Roles.of(roles)
    keys = group_cols(by)
    flag = label_flag(df, roles)
    dept = roles.col(df, "department")
    names = {r: roles.col(df, r) for r in MEANS}
    leavers = count_if(flag) if flag is not None else F.lit(0).cast("bigint")
    parts = [F.count(F.lit(1)).alias("n"), leavers.alias("leavers")]
    for r, name in names.items():
        if name:
            parts += [F.sum(col(name).cast("double")).alias(f"sum_{r}"), F.count(col(name)).alias(f"n_{r}")]
    inner = [*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *([col(dept).alias("_dept")] if dept else [])]
    per = df.groupBy(*inner).agg(*parts)
    r = pct(F.col("leavers"), F.col("n"))
    stable = F.greatest(F.lit(0.0), F.lit(100.0) - r * STABILITY_PENALTY)
    whole = [F.sum("n").alias("n"), pct(F.sum("leavers"), F.sum("n")).alias("attrition_rate"),
             (rnd(F.avg(F.when(F.col("_dept").isNotNull(), stable)), 1) if dept else F.lit(None).cast("double"))
             .alias("department_stability_score"),
             *[(F.try_divide(F.sum(f"sum_{r}"), F.sum(f"n_{r}").cast("double")) if name else F.lit(None).cast("double"))
               .alias(f"mean_{r}") for r, name in names.items()]]
    outer = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    return per.groupBy(*outer).agg(*whole) if keys else per.agg(*whole)


def workforce_scores(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None
                     ) -> DataFrame:
    roles = Roles.of(roles)
    keys = group_cols(by)
    s = stats(df, roles, keys)
    has = {r: roles.col(df, r) is not None for r in
           ("satisfaction", "environment", "worklife", "involvement", "rating", "tenure", "training")}

    def m(role: str) -> Column:
        return F.col(f"mean_{role}")

    def quarter(role: str) -> Column:
        return m(role) / 4.0 * 100.0

    r = F.col("attrition_rate")
    health = [quarter(x) for x in ("satisfaction", "environment", "worklife") if has[x]]
    if has["rating"]:
        health.append(clamp((m("rating") - 3.0) / 1.0 * 100.0, 0.0, 100.0))
    health.append(F.greatest(F.lit(0.0), F.lit(100.0) - r * RETENTION_PENALTY))
    engagement = [quarter(x) for x in ("involvement", "satisfaction", "environment") if has[x]]
    risk = [F.when(r > RISK_RATE_MIN, F.least(F.lit(100.0), r * 5.0))]
    if has["satisfaction"]:
        risk.append(F.when(m("satisfaction") < RISK_SAT_LOW, F.lit(RISK_SAT_PART)))
    if has["worklife"]:
        risk.append(F.when(m("worklife") < RISK_WLB_LOW, F.lit(RISK_WLB_PART)))
    productivity = []
    if has["rating"]:
        productivity.append(quarter("rating"))
    if has["tenure"]:
        productivity.append(clamp(m("tenure") / TENURE_FULL * 100.0, None, 100.0))
    if has["training"]:
        productivity.append(clamp(m("training") / TRAINING_FULL * 100.0, None, 100.0))

    return s.select(
        *[col(k) for k in keys],
        rnd(mean_of(health), 1).alias("workforce_health_score"),
        rnd(mean_of(engagement), 1).alias("engagement_score"),
        rnd(F.coalesce(mean_of(risk), r * RISK_FALLBACK_FACTOR), 1).alias("workforce_risk_index"),
        rnd(F.greatest(F.lit(0.0), F.lit(100.0) - r * RETENTION_EFF_PENALTY), 1).alias("retention_effectiveness"),
        rnd(mean_of(productivity), 1).alias("productivity_score"),
        "department_stability_score",
    )
