"""Report tables and report files.

``report_sections`` gathers overview, scores, insights, recommendations and
(optionally) model results into one long table (section, ordinal, key,
label, value): the body of every report format. Each part is a small
aggregate result, so the union is bounded by the number of metrics and
rules, not by the data; writing it as one file (``coalesce(1)``) is safe.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.functions.exprs import title_key
from hrsight.operators import describe, findings, scores
from hrsight.roles import Roles

OVERVIEW_KEYS = ["total_employees", "total_departments", "total_job_roles", "avg_age", "avg_income",
                 "avg_tenure", "attrition_rate"]
SCORE_KEYS = ["workforce_health_score", "engagement_score", "department_stability_score",
              "workforce_risk_index", "retention_effectiveness", "productivity_score"]


def _kv(section: str, wide: DataFrame, keys: list[str]) -> DataFrame:
    items = [F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
             for i, k in enumerate(keys)]
    return wide.select(F.explode(F.array(*items)).alias("s")).select(
        F.lit(section).alias("section"), "s.ordinal", "s.key", title_key(F.col("s.key")).alias("label"), "s.value")


def report_sections(df: DataFrame, roles: Roles | None = None, model_results: DataFrame | None = None) -> DataFrame:
    roles = Roles.of(roles)
    ov = _kv("overview", describe.overview(df, roles), OVERVIEW_KEYS)
    sc = _kv("scores", scores.workforce_scores(df, roles), SCORE_KEYS)
    recs, insights = findings.findings(df, roles)
    ins = insights.select(
        F.lit("insights").alias("section"), F.col("rule_no").alias("ordinal"), F.col("type").alias("key"),
        F.col("severity").alias("label"),
        F.to_json(F.struct("type", "severity", "insight", "recommendation")).alias("value"))
    rec = recs.select(
        F.lit("recommendations").alias("section"), F.col("rule_no").alias("ordinal"),
        F.col("category").alias("key"), F.col("priority").alias("label"),
        F.to_json(F.struct("priority", "category", "target", "issue", "recommendation", "action_plan"))
        .alias("value"))
    out = ov.unionByName(sc).unionByName(ins).unionByName(rec)
    if model_results is not None:
        out = out.unionByName(model_results.select(
            F.lit("model_results").alias("section"), F.lit(0).alias("ordinal"), F.col("model").alias("key"),
            F.col("model").alias("label"), F.to_json(F.struct(*model_results.columns)).alias("value")))
    return out


def text_lines(sections: DataFrame) -> DataFrame:
    """Plain-text report body: ``key: value`` for overview and scores,
    ``[priority] category: recommendation`` for recommendations."""
    rec = F.from_json(F.col("value"), "priority string, category string, recommendation string")
    line = (F.when(F.col("section").isin("overview", "scores"), F.concat_ws(": ", "key", "value"))
            .when(F.col("section") == "recommendations",
                  F.concat(F.lit("["), rec.priority, F.lit("] "), rec.category, F.lit(": "), rec.recommendation)))
    order = (F.when(F.col("section") == "overview", 0).when(F.col("section") == "scores", 1)
             .when(F.col("section") == "recommendations", 2).otherwise(3))
    return (sections.select(order.alias("_o"), "ordinal", "key", line.alias("line"))
            .where(F.col("line").isNotNull()).orderBy("_o", "ordinal", "key").select("line"))


def report_filename(fmt: str, now: datetime | None = None) -> str:
    """``report_<yyyymmdd>_<hhmmss>.<fmt>``."""
    return f"report_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}.{fmt}"


def write_json_report(sections: DataFrame, path: str) -> None:
    sections.coalesce(1).write.mode("overwrite").json(path)


def write_text_report(sections: DataFrame, path: str) -> None:
    text_lines(sections).coalesce(1).write.mode("overwrite").text(path)
