"""Descriptive workforce metrics (rates, overview, distributions, pay).

Every function takes the employee frame and a role map and returns a lazy
DataFrame. Group-wise metrics are one ``groupBy`` (partial aggregation before
the shuffle, so a department holding a third of all rows costs one row per
map task); whole-table metrics are one multi-expression ``agg``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrsight.functions.exprs import col, count_if, group_cols, label_flag, pct, rate, rnd
from hrsight.functions.quantiles import exact_quantiles, grouped_quantiles
from hrsight.operators import sketches
from hrsight.roles import Roles


def _avg(df: DataFrame, roles: Roles, role: str, digits: int, alias: str) -> Column:
    name = roles.col(df, role)
    if name is None:
        return F.lit(None).cast("double").alias(alias)
    return rnd(F.avg(col(name)), digits).alias(alias)


def _all_not_null(keys: list[str]) -> Column:
    cond = col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & col(k).isNotNull()
    return cond


def band(rate_col: Column, high: float = 20.0, mid: float | None = 10.0) -> Column:
    """Attrition band: above ``high`` danger, above ``mid`` warning, else success."""
    out = F.when(rate_col > high, "danger")
    if mid is not None:
        out = out.when(rate_col > mid, "warning")
    return out.otherwise("success")


def attrition_rate(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None
                   ) -> DataFrame:
    """Headcount, leavers and attrition rate (2 dp), overall or per group.

    Rows with a NULL group key are dropped (a NULL key is not a group).
    """
    roles = Roles.of(roles)
    keys = group_cols(by)
    flag = label_flag(df, roles)
    leavers = count_if(flag) if flag is not None else F.lit(0).cast("long")
    aggs = [F.count(F.lit(1)).alias("employees"), leavers.alias("leavers"), rate(flag).alias("attrition_rate")]
    if keys:
        out = df.where(_all_not_null(keys)).groupBy(*[col(k) for k in keys]).agg(*aggs)
        return out.withColumn("band", band(F.col("attrition_rate")))
    out = df.agg(*aggs)
    return out.withColumn("band", band(F.col("attrition_rate"), high=15.0, mid=None))


def department_metrics(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None
                       ) -> DataFrame:
    """Per department: headcount, mean age/income/tenure/satisfaction/rating,
    attrition rate and band."""
    roles = Roles.of(roles)
    dept = roles.col(df, "department")
    if dept is None:
        return df.sparkSession.createDataFrame([], "department string")
    keys = group_cols(by) + [dept]
    flag = label_flag(df, roles)
    out = (df.where(col(dept).isNotNull())
           .groupBy(*[col(k) for k in keys])
           .agg(F.count(F.lit(1)).alias("employee_count"),
                _avg(df, roles, "age", 1, "avg_age"),
                _avg(df, roles, "income", 0, "avg_income"),
                _avg(df, roles, "tenure", 1, "avg_tenure"),
                _avg(df, roles, "satisfaction", 2, "avg_satisfaction"),
                _avg(df, roles, "rating", 2, "avg_performance"),
                rate(flag).alias("attrition_rate")))
    return (out.withColumnRenamed(dept, "department")
            .withColumn("band", band(F.col("attrition_rate"))))


def overview(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None,
             distinct: str = "exact") -> DataFrame:
    """Workforce overview: headcount, distinct departments and roles, mean
    age (1 dp), income (0 dp), tenure (1 dp), attrition rate.

    The data is aggregated once per (group, department, role); distinct counts
    and means are then taken over that small frame. Where departments or roles
    are free text, that frame isn't small: ``distinct="approx"`` takes the two
    counts from sketches (``sketches.relative_error``) in one aggregation."""
    roles = Roles.of(roles)
    keys = group_cols(by)
    flag = label_flag(df, roles)
    dims = {"department": "total_departments", "job_role": "total_job_roles"}
    means = {"age": 1, "income": 0, "tenure": 1}
    names = {r: roles.col(df, r) for r in (*dims, *means)}
    inner = [col(k).alias(f"_k{i}") for i, k in enumerate(keys)] + [col(names[r]).alias(f"_{r}") for r in dims if names[r]]
    parts = [F.count(F.lit(1)).alias("n"), (count_if(flag) if flag is not None else F.lit(0).cast("bigint")).alias("leavers")]
    for r in means:
        if names[r]:
            parts += [F.sum(col(names[r]).cast("double")).alias(f"sum_{r}"), F.count(col(names[r])).alias(f"n_{r}")]
    per = df.groupBy(*inner).agg(*parts)
    none = F.lit(None).cast("double")
    if distinct == "approx":
        # one row is one person: the same expressions on a frame that isn't aggregated before
        per = df.select(*inner, F.lit(1).alias("n"), *([flag.cast("bigint").alias("leavers")] if flag is not None else [F.lit(0).alias("leavers")]),
                        *[e for r in means if names[r] for e in (col(names[r]).cast("double").alias(f"sum_{r}"),
                                                                 col(names[r]).isNotNull().cast("int").alias(f"n_{r}"))])

    def count(r: str):
        if distinct == "approx":
            return F.hll_sketch_estimate(F.hll_sketch_agg(F.col(f"_{r}").cast("string"), F.lit(sketches.LG_REGISTERS)))
        return F.count_distinct(f"_{r}")

    out = [F.coalesce(F.sum("n"), F.lit(0)).alias("total_employees"),
           *[(count(r) if names[r] else F.lit(0)).cast("long").alias(alias) for r, alias in dims.items()],
           *[(rnd(F.try_divide(F.sum(f"sum_{r}"), F.sum(f"n_{r}").cast("double")), d) if names[r] else none).alias(f"avg_{r}")
             for r, d in means.items()],
           pct(F.coalesce(F.sum("leavers"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("attrition_rate")]
    outer = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    return per.groupBy(*outer).agg(*out) if keys else per.agg(*out)


def distribution(df: DataFrame, column: str, by: str | Iterable[str] | None = None) -> DataFrame:
    """Value counts (NULLs out) with the share of the non-NULL total, count
    descending then value. The total is a one-row aggregate joined by
    broadcast (a single row, so its size is fixed), not an unpartitioned
    window."""
    keys = group_cols(by)
    counts = (df.where(col(column).isNotNull())
              .groupBy(*keys, col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    if keys:
        totals = counts.groupBy(*[col(k) for k in keys]).agg(F.sum("n").alias("_total"))
        out = counts.join(totals, keys)
    else:
        totals = counts.agg(F.sum("n").alias("_total"))
        out = counts.crossJoin(F.broadcast(totals))
    return (out.withColumn("share_pct", pct(F.col("n"), F.col("_total")))
            .drop("_total").orderBy(*keys, F.desc("n"), "value"))


def role_distribution(df: DataFrame, roles: Roles | None, role: str, by=None) -> DataFrame:
    roles = Roles.of(roles)
    name = roles.col(df, role)
    if role == "education" and name is None:
        name = roles.col(df, "education_level")
    if name is None:
        return df.sparkSession.createDataFrame([], "value string, n long, share_pct double")
    return distribution(df, name, by)


def performance_distribution(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Rating, satisfaction and work-life value counts in one pass
    (``unpivot`` then one ``groupBy``), with each metric's mean (2 dp)."""
    roles = Roles.of(roles)
    present = [(m, roles.col(df, r)) for m, r in (("rating", "rating"), ("satisfaction", "satisfaction"),
                                                  ("worklife", "worklife"))]
    present = [(m, c) for m, c in present if c is not None]
    if not present:
        return df.sparkSession.createDataFrame([], "metric string, value double, n long, mean double")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"),
                                                  col(c).cast("double").alias("value"))
                                         for m, c in present])).alias("s")).select("s.*")
    counts = long.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(
        F.count(F.lit(1)).alias("n"))
    means = counts.groupBy("metric").agg(
        rnd(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), 2).alias("mean"))
    return counts.join(F.broadcast(means), "metric").orderBy("metric", "value")


def performer_counts(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """High performers (rating >= q75) and underperformers (rating <= q25):
    counts and percent of all rows (1 dp). Quantiles are exact (see
    ``exact_quantiles``) and enter the plan as literals."""
    roles = Roles.of(roles)
    rating = roles.col(df, "rating")
    schema = ("q25 double, q75 double, high_performer_count long, high_performer_pct double, "
              "underperformer_count long, underperformer_pct double")
    if rating is None:
        return df.sparkSession.createDataFrame([], schema)
    q25, q75 = exact_quantiles(df, {rating: [0.25, 0.75]})[rating]
    r = col(rating)
    n = F.count(F.lit(1))
    hi = count_if(r >= F.lit(q75)) if q75 is not None else F.lit(0).cast("long")
    lo = count_if(r <= F.lit(q25)) if q25 is not None else F.lit(0).cast("long")
    return df.agg(F.lit(q25).cast("double").alias("q25"), F.lit(q75).cast("double").alias("q75"),
                  hi.alias("high_performer_count"), pct(hi, n, 1).alias("high_performer_pct"),
                  lo.alias("underperformer_count"), pct(lo, n, 1).alias("underperformer_pct"))


def salary_stats(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None) -> DataFrame:
    """Mean, median, sample std, min, max, q25, q75 of income (0 dp), of the
    whole table or of each group (``by``). All quantiles are exact."""
    roles = Roles.of(roles)
    inc = roles.col(df, "income")
    keys = group_cols(by)
    if inc is None:
        return df.sparkSession.createDataFrame([], "mean double")
    x = col(inc).cast("double")
    base = [rnd(F.avg(x), 0).alias("mean"), rnd(F.stddev_samp(x), 0).alias("std"),
            rnd(F.min(x), 0).alias("min"), rnd(F.max(x), 0).alias("max")]
    if keys:
        q = grouped_quantiles(df, keys, inc, [0.5, 0.25, 0.75]).select(
            *[F.col(f"`{k}`").alias(f"_q_{i}") for i, k in enumerate(keys)], "q0", "q1", "q2")
        stats = df.groupBy(*[col(k) for k in keys]).agg(*base)
        on = [stats[f"`{k}`"].eqNullSafe(q[f"_q_{i}"]) for i, k in enumerate(keys)]
        return stats.join(q, on).select(
            *[stats[f"`{k}`"] for k in keys], "mean", rnd(F.col("q0"), 0).alias("median"), "std", "min", "max",
            rnd(F.col("q1"), 0).alias("q25"), rnd(F.col("q2"), 0).alias("q75"))
    med, q25, q75 = exact_quantiles(df, {inc: [0.5, 0.25, 0.75]})[inc]
    return df.agg(*base).select(
        "mean", rnd(F.lit(med), 0).alias("median"), "std", "min", "max",
        rnd(F.lit(q25), 0).alias("q25"), rnd(F.lit(q75), 0).alias("q75"))


def pay_by_group(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Mean income (0 dp) per gender, per department and per job role in one
    pass: GROUPING SETS, with ``grouping_id`` telling a rolled-up key from a
    NULL key. Rows whose key is NULL are dropped."""
    roles = Roles.of(roles)
    inc = roles.col(df, "income")
    dims = [(d, roles.col(df, d)) for d in ("gender", "department", "job_role")]
    dims = [(d, c) for d, c in dims if c is not None]
    if inc is None or not dims:
        return df.sparkSession.createDataFrame([], "dimension string, value string, avg_income double")
    names = [c for _, c in dims]
    body = df.groupingSets([[col(c)] for c in names], *[col(c) for c in names]).agg(
        F.grouping_id(*[col(c) for c in names]).alias("gid"),
        F.bround(F.avg(col(inc).cast("double")), 0).alias("avg_income"))
    k = len(names)
    branches = []
    for i, (d, c) in enumerate(dims):
        gid_val = (2 ** k - 1) - (2 ** (k - 1 - i))
        branches.append(F.when(F.col("gid") == gid_val,
                               F.struct(F.lit(d).alias("dimension"), col(c).cast("string").alias("value"))))
    picked = F.coalesce(*branches)
    return (body.select(picked.alias("s"), "avg_income")
            .select("s.dimension", "s.value", "avg_income")
            .where(F.col("value").isNotNull()))


def attrition_crosstab(df: DataFrame, roles: Roles | None = None, wide: Sequence[str] | None = None) -> DataFrame:
    """Attrition percent per (department, job role) cell; a cell without rows
    has 0 employees and 0.0. ``wide`` lists job roles to be columns of a wide
    table (the caller knows them, so nothing is gathered to find them).
    """
    roles = Roles.of(roles)
    dept, role = roles.col(df, "department"), roles.col(df, "job_role")
    flag = label_flag(df, roles)
    if dept is None or flag is None:
        return df.sparkSession.createDataFrame([], "department string, job_role string, attrition_pct double")
    if role is None:
        return attrition_rate(df, roles, by=dept).withColumnRenamed(dept, "department")
    cells = (df.where(col(dept).isNotNull() & col(role).isNotNull())
             .groupBy(col(dept).alias("department"), col(role).alias("job_role"))
             .agg(F.count(F.lit(1)).alias("employees"), rate(flag).alias("attrition_pct")))
    if wide is not None:
        return (cells.groupBy("department").pivot("job_role", list(wide))
                .agg(F.first("attrition_pct")).na.fill(0.0))
    # the grid is the result itself: departments times roles, from the aggregated cells
    grid = cells.select("department").distinct().crossJoin(cells.select("job_role").distinct())
    return grid.join(cells, ["department", "job_role"], "left").na.fill({"employees": 0, "attrition_pct": 0.0})


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram: ``bins`` buckets between min and max (the last
    one closed), empty buckets omitted. min/max come from a one-row
    aggregate joined by broadcast."""
    x = col(column).cast("double")
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    mm = vals.agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    return (vals.crossJoin(F.broadcast(mm)).withColumn("bin", b)
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .select("bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_hi"),
                    "n")
            .orderBy("bin"))


def role_histogram(df: DataFrame, roles: Roles | None, role: str, bins: int) -> DataFrame:
    roles = Roles.of(roles)
    name = roles.col(df, role)
    if name is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    return histogram(df, name, bins)


# The four survey columns of the satisfaction chart, in order.
SATISFACTION_ROLES: tuple[str, ...] = ("satisfaction", "environment", "worklife", "involvement")


def satisfaction_levels(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Counts per level of the four survey columns (one pass, ``unpivot``).
    Series name: the column name with "Satisfaction" shortened to " Sat" and
    "Balance" spaced; level label "Level k"."""
    roles = Roles.of(roles)
    cols = [roles.col(df, r) for r in SATISFACTION_ROLES]
    cols = [c for c in cols if c is not None]
    if not cols:
        return df.sparkSession.createDataFrame([], "series string, level int, label string, n long")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                  col(c).cast("int").alias("level"))
                                         for c in cols])).alias("s")).select("s.*")
    series = F.replace(F.replace(F.col("column"), F.lit("Satisfaction"), F.lit(" Sat")),
                       F.lit("Balance"), F.lit(" Balance"))
    return (long.where(F.col("level").isNotNull())
            .groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"))
            .select(series.alias("series"), "level",
                    F.concat(F.lit("Level "), F.col("level").cast("string")).alias("label"), "n")
            .orderBy("series", "level"))


def pay_gap_raw(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """One row: the departments with the highest and lowest mean income
    (ties: first name alphabetically), both means and the gap
    (max - min) / mean of the department means * 100, unrounded."""
    roles = Roles.of(roles)
    dept, inc = roles.col(df, "department"), roles.col(df, "income")
    means = (df.where(col(dept).isNotNull()).groupBy(col(dept))
             .agg(F.avg(col(inc).cast("double")).alias("m")))
    return means.agg(
        F.min_by(col(dept), F.struct(F.negative(F.col("m")), col(dept))).alias("max_department"),
        F.max("m").alias("max_avg_income"),
        F.min_by(col(dept), F.struct(F.col("m"), col(dept))).alias("min_department"),
        F.min("m").alias("min_avg_income"),
        (F.try_divide(F.max("m") - F.min("m"), F.avg("m")) * F.lit(100.0)).alias("gap"))


def department_pay_gap(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Spread of department mean income (A24), rounded for display."""
    roles = Roles.of(roles)
    if not roles.has(df, "department", "income"):
        return df.sparkSession.createDataFrame(
            [], "max_department string, max_avg_income double, min_department string, "
                "min_avg_income double, pay_gap_pct double")
    return pay_gap_raw(df, roles).select(
        "max_department", rnd(F.col("max_avg_income"), 0).alias("max_avg_income"),
        "min_department", rnd(F.col("min_avg_income"), 0).alias("min_avg_income"),
        rnd(F.col("gap"), 2).alias("pay_gap_pct"))
