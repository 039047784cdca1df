"""Rule-based retention recommendations and insights.

Evidence for every rule comes from one conditional aggregate over the
employee frame (one scan; the income quartile and median are exact
quantiles computed beforehand and enter as literals), one per-department
rate aggregate (R1) and one per-department income aggregate (I4). Each rule
is a row of an ``array(struct)`` with a ``fired`` flag, exploded and
filtered, so the result is a small lazy DataFrame; nothing is collected
besides the two quantiles.

Rates are rounded to 2 dp before they are compared (strict ``>``), as the
thresholds are defined on the rounded rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrsight.functions.exprs import col, count_if, label_flag, not_truthy, pct, rate, rnd, truthy
from hrsight.functions.quantiles import exact_quantiles
from hrsight.operators.describe import pay_gap_raw
from hrsight.roles import Roles

# Rule thresholds (defaults; every one is a parameter).
THRESHOLDS = {
    "dept_rate": 20.0,          # R1 department attrition above
    "low_income_rate": 15.0,    # R2 attrition of bottom-quartile earners above
    "low_sat_share": 0.15,      # R3 satisfaction <= 2 in more than this share of rows
    "overtime_rate": 20.0,      # R4 attrition of overtime workers above
    "promo_gap_years": 5,       # R5 years since last promotion above
    "promo_rate": 15.0,         # R5 attrition of that group above
    "overtime_ratio": 1.5,      # I1 overtime rate above ratio x others
    "income_ratio": 1.5,        # I2 below-median rate above ratio x others
    "sat_ratio": 2.0,           # I3 low-satisfaction rate above ratio x satisfied
    "pay_gap_pct": 30.0,        # I4 department pay gap above
    "age_old": 45.0,            # I5 mean age above
    "age_young": 28.0,          # I6 mean age below
}

# Category, priority and target of each recommendation are fixed values; the
# sentences are this library's own. "{dept}" is the department's name.
RECOMMENDATION_TEXT = {
    1: ("Department Risk", "High", "{dept}",
        "Ask leavers and staff of {dept} for their reasons and agree changes with its managers.",
        ["Collect leaving reasons in {dept} for the past year", "Compare hours and staffing in {dept} with other departments",
         "Set a target rate for {dept} and check it monthly"]),
    2: ("Compensation", "High", "Low-income employees",
        "Check whether the lowest quarter of salaries is below what other employers pay.",
        ["List the roles in the lowest pay quarter", "Compare each with an outside pay survey",
         "Budget raises where the difference is largest"]),
    3: ("Employee Satisfaction", "Medium", "Low satisfaction employees",
        "Learn what makes satisfaction scores low and fix the most frequent causes first.",
        ["Ask everyone with a score of 1 or 2 for the cause", "Rank the causes by how many name them",
         "Repeat the measurement after half a year"]),
    4: ("Workload Management", "High", "Overtime employees",
        "Bring hours down where overtime goes along with leaving.",
        ["Find the teams with the most overtime", "Move work or positions to these teams",
         "Agree an upper limit of monthly overtime"]),
    5: ("Career Growth", "Medium", "Long-tenure without promotion",
        "Talk about the next step with everyone who has waited long for a promotion.",
        ["List who waits longest in each department", "Name the conditions for the next grade in writing",
         "Open internal positions to these employees first"]),
    6: ("General", "Low", "All employees",
        "No rule fired; keep measuring.",
        ["Recompute these figures with the next data set", "Look at segments with few employees by hand"]),
}

# {v} is the rate or share in percent with 1 decimal, {k} a row count.
ISSUE_TEXT = {
    1: "{v}% of the department left",
    2: "{v}% of the lowest pay quarter left",
    3: "{k} employees, {v}% of all, are at satisfaction 1 or 2",
    4: "{v}% of those with overtime left",
    5: "{v}% of those more than five years from their last promotion left",
    6: "All measures are below their thresholds",
}

# Type and severity are fixed values; the sentences are this library's own.
# {a}/{b} are rates with 1 decimal, {hi}/{lo} department names, {hv}/{lv}
# whole-unit means, {age} the mean age with 1 decimal.
INSIGHT_TEXT = {
    1: ("Attrition Driver", "High",
        "With overtime {a}% left, without it {b}%.",
        "Look for teams in which overtime has become the rule."),
    2: ("Compensation Risk", "High",
        "Below the median income {a}% left, above it {b}%.",
        "Compare the pay of the lower half with the market."),
    3: ("Satisfaction Risk", "Critical",
        "At low satisfaction {a}% left, at high satisfaction {b}%.",
        "Treat a low satisfaction score as an early warning."),
    4: ("Pay Equity", "Medium",
        "Mean income is {hv} in {hi} and {lv} in {lo}.",
        "Check whether the roles explain the difference."),
    5: ("Aging Workforce", "Medium",
        "The mean age is {age} years.",
        "Plan who takes over from those who retire soon."),
    6: ("Young Workforce", "Low",
        "The mean age is {age} years.",
        "Offer training and clear grades early."),
}

REC_SCHEMA = ("rule_no int, category string, priority string, target string, issue string, "
              "recommendation string, action_plan array<string>, metric_value double, employees long")
INSIGHT_SCHEMA = ("rule_no int, type string, severity string, insight string, recommendation string, "
                  "metric_value double, compare_value double")


def _fmt1(c: Column) -> Column:
    """Python-style ``:.1f`` (half-even on the exact double) for values < 1000."""
    return F.regexp_replace(F.format_number(c, 1), ",", "")


def _fmt0(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 0), ",", "")


def _fill(template: str, **parts: Column) -> Column:
    """Template with ``{name}`` slots -> ``concat`` of literals and columns."""
    out: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            out.append(F.lit(rest[:i]))
        out.append(parts[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*out) if out else F.lit("")


def _evidence(df: DataFrame, roles: Roles, t: dict) -> tuple[DataFrame, dict]:
    """The one-row evidence frame and which parts exist."""
    flag = label_flag(df, roles)
    inc = roles.col(df, "income")
    quant = exact_quantiles(df, {inc: [0.25, 0.5]})[inc] if inc and flag is not None else [None, None]
    q25, med = quant
    n = F.count(F.lit(1))
    aggs = [n.alias("n")]
    have = {"label": flag is not None}

    def sub(name: str, where: Column) -> None:
        aggs.append(pct(count_if(where & flag), count_if(where)).alias(f"{name}_rate"))

    if flag is not None:
        if inc is not None and q25 is not None:
            have["income"] = True
            x = col(inc)
            sub("low_income", x < F.lit(q25))
            sub("below_median", x < F.lit(med))
            sub("above_median", x >= F.lit(med))
        sat = roles.col(df, "satisfaction")
        if sat is not None:
            have["satisfaction"] = True
            aggs.append(count_if(col(sat) <= 2).alias("low_sat_count"))
            sub("low_sat", col(sat) <= 2)
            sub("high_sat", col(sat) >= 4)
        ot = roles.col(df, "overtime")
        if ot is not None:
            have["overtime"] = True
            sub("overtime", F.coalesce(truthy(col(ot)), F.lit(False)))
            sub("no_overtime", not_truthy(col(ot)))
        gap = roles.col(df, "promotion_gap")
        if gap is not None:
            have["promotion"] = True
            sub("no_promo", col(gap) > t["promo_gap_years"])
    age = roles.col(df, "age")
    if age is not None:
        have["age"] = True
        aggs.append(F.avg(col(age).cast("double")).alias("avg_age"))
    return df.agg(*aggs), have


def findings(df: DataFrame, roles: Roles | None = None, **thresholds) -> tuple[DataFrame, DataFrame]:
    """(recommendations, insights) from one shared evidence aggregate (and
    one quantile computation)."""
    roles = Roles.of(roles)
    t = {**THRESHOLDS, **thresholds}
    evidence = _evidence(df, roles, t)
    return (recommendations(df, roles, _evidence_of=evidence, **thresholds),
            insights(df, roles, _evidence_of=evidence, **thresholds))


def recommendations(df: DataFrame, roles: Roles | None = None, _evidence_of=None, **thresholds) -> DataFrame:
    """R1-R6 as rows ``REC_SCHEMA``, ordered by rule then target."""
    roles = Roles.of(roles)
    t = {**THRESHOLDS, **thresholds}
    spark = df.sparkSession
    flag = label_flag(df, roles)
    ev, have = _evidence_of or _evidence(df, roles, t)
    parts: list[DataFrame] = []

    def rec_row(no: int, fired: Column, value: Column, k: Column | None = None,
                shown: Column | None = None) -> Column:
        cat, pri, target, text, plan = RECOMMENDATION_TEXT[no]
        v = _fmt1(shown if shown is not None else value)
        issue = _fill(ISSUE_TEXT[no], v=v, k=(k.cast("string") if k is not None else F.lit("")))
        return F.struct(fired.alias("fired"), F.lit(no).alias("rule_no"), F.lit(cat).alias("category"),
                        F.lit(pri).alias("priority"), F.lit(target).alias("target"), issue.alias("issue"),
                        F.lit(text).alias("recommendation"),
                        F.array(*[F.lit(p) for p in plan]).alias("action_plan"),
                        value.cast("double").alias("metric_value"),
                        (k if k is not None else F.lit(None)).cast("long").alias("employees"))

    dept = roles.col(df, "department")
    if flag is not None and dept is not None:
        per = df.where(col(dept).isNotNull()).groupBy(col(dept)).agg(rate(flag).alias("r"))
        cat, pri, _, text, plan = RECOMMENDATION_TEXT[1]
        d = col(dept).cast("string")
        parts.append(per.where(F.col("r") > t["dept_rate"]).select(
            F.lit(1).alias("rule_no"), F.lit(cat).alias("category"), F.lit(pri).alias("priority"),
            d.alias("target"), _fill(ISSUE_TEXT[1], v=_fmt1(F.col("r"))).alias("issue"),
            _fill(text, dept=d).alias("recommendation"),
            F.array(*[_fill(p, dept=d) for p in plan]).alias("action_plan"),
            F.col("r").alias("metric_value"), F.lit(None).cast("long").alias("employees")))
    rows = []
    if have.get("income"):
        rows.append(rec_row(2, F.col("low_income_rate") > t["low_income_rate"], F.col("low_income_rate")))
    if have.get("satisfaction"):
        raw = F.coalesce(F.try_divide(F.col("low_sat_count"), F.col("n")), F.lit(0.0)) * 100.0
        rows.append(rec_row(3, F.col("low_sat_count") > F.col("n") * t["low_sat_share"],
                            pct(F.col("low_sat_count"), F.col("n")), F.col("low_sat_count"), shown=raw))
    if have.get("overtime"):
        rows.append(rec_row(4, F.col("overtime_rate") > t["overtime_rate"], F.col("overtime_rate")))
    if have.get("promotion"):
        rows.append(rec_row(5, F.col("no_promo_rate") > t["promo_rate"], F.col("no_promo_rate")))
    if rows:
        parts.append(ev.select(F.explode(F.array(*rows)).alias("s"))
                     .where(F.col("s.fired")).select("s.*").drop("fired"))
    fired = parts[0] if parts else spark.createDataFrame([], REC_SCHEMA)
    for p in parts[1:]:
        fired = fired.unionByName(p)
    # Exactly one row when nothing else fired (the count is one row).
    none = fired.agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == 0)
    cat, pri, target, text, plan = RECOMMENDATION_TEXT[6]
    general = none.select(
        F.lit(6).alias("rule_no"), F.lit(cat).alias("category"), F.lit(pri).alias("priority"),
        F.lit(target).alias("target"), F.lit(ISSUE_TEXT[6]).alias("issue"),
        F.lit(text).alias("recommendation"), F.array(*[F.lit(p) for p in plan]).alias("action_plan"),
        F.lit(None).cast("double").alias("metric_value"), F.lit(None).cast("long").alias("employees"))
    return fired.unionByName(general).orderBy("rule_no", "target")


def insights(df: DataFrame, roles: Roles | None = None, _evidence_of=None, **thresholds) -> DataFrame:
    """I1-I6 as rows ``INSIGHT_SCHEMA``, ordered by rule."""
    roles = Roles.of(roles)
    t = {**THRESHOLDS, **thresholds}
    spark = df.sparkSession
    ev, have = _evidence_of or _evidence(df, roles, t)

    def row(no: int, fired: Column, a: Column | None, b: Column | None, **text_parts: Column) -> Column:
        typ, sev, text, rec = INSIGHT_TEXT[no]
        parts = dict(text_parts)
        if a is not None:
            parts["a"] = _fmt1(a)
        if b is not None:
            parts["b"] = _fmt1(b)
        return F.struct(fired.alias("fired"), F.lit(no).alias("rule_no"), F.lit(typ).alias("type"),
                        F.lit(sev).alias("severity"), _fill(text, **parts).alias("insight"),
                        F.lit(rec).alias("recommendation"),
                        (a if a is not None else F.lit(None)).cast("double").alias("metric_value"),
                        (b if b is not None else F.lit(None)).cast("double").alias("compare_value"))

    rows = []
    if have.get("overtime"):
        a, b = F.col("overtime_rate"), F.col("no_overtime_rate")
        rows.append(row(1, a > b * t["overtime_ratio"], a, b))
    if have.get("income"):
        a, b = F.col("below_median_rate"), F.col("above_median_rate")
        rows.append(row(2, a > b * t["income_ratio"], a, b))
    if have.get("satisfaction"):
        a, b = F.col("low_sat_rate"), F.col("high_sat_rate")
        rows.append(row(3, a > b * t["sat_ratio"], a, b))
    if have.get("age"):
        age = F.col("avg_age")
        rows.append(row(5, age > t["age_old"], rnd(age, 1), None, age=_fmt1(age)))
        rows.append(row(6, age < t["age_young"], rnd(age, 1), None, age=_fmt1(age)))
    parts: list[DataFrame] = []
    if rows:
        parts.append(ev.select(F.explode(F.array(*rows)).alias("s"))
                     .where(F.coalesce(F.col("s.fired"), F.lit(False))).select("s.*").drop("fired"))
    if roles.has(df, "department", "income"):
        gap = pay_gap_raw(df, roles)
        typ, sev, text, rec = INSIGHT_TEXT[4]
        parts.append(gap.where(F.col("gap") > t["pay_gap_pct"]).select(
            F.lit(4).alias("rule_no"), F.lit(typ).alias("type"), F.lit(sev).alias("severity"),
            _fill(text, hi=F.col("max_department"), hv=_fmt0(F.col("max_avg_income")),
                  lo=F.col("min_department"), lv=_fmt0(F.col("min_avg_income"))).alias("insight"),
            F.lit(rec).alias("recommendation"), rnd(F.col("gap"), 2).alias("metric_value"),
            F.lit(None).cast("double").alias("compare_value")))
    if not parts:
        return spark.createDataFrame([], INSIGHT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rule_no")

