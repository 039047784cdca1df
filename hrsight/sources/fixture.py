"""Employee-shaped view over the order/customer/line-item test tables.

The test tables carry no HR columns, so the registered queries run on a view
with one row per order (key ``EmployeeID``). The same definition exists as
SQL text (``EMPLOYEE_VIEW_SQL``) for the DuckDB oracle; both produce the same
rows.

Plan notes (scale): the line items are pre-aggregated per order key before
the join (partial aggregation, so a hot order key costs one row per map
task). Orders and that aggregate have about the same row count, so their
join is a sort-merge join on the order key (``merge`` hint): it reuses the
aggregate's hash partitioning (no second exchange on that side) and spreads
the orders over the shuffle partitions even when the order files are few
and large, which a broadcast join would not (it keeps the scan's
partitioning). The customer side is left to Spark's size-checked automatic
broadcast (static statistics or AQE's runtime sizes); beyond the threshold
it is a sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def employee_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n"),
               F.sum("l_quantity").alias("qty"),
               F.max("l_linenumber").alias("mx"),
               F.min("l_linenumber").alias("mn"),
               F.max("l_discount").alias("disc"),
               F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("ret")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
         .join(li.hint("merge"), o.o_orderkey == li.l_orderkey, "left"))
    qty4 = F.col("qty").cast("int") % 4
    return j.select(
        F.concat(F.lit("EMP_"), F.col("o_orderkey").cast("string")).alias("EmployeeID"),
        F.when(F.col("c_nationkey") % 2 == 0, "Female").otherwise("Male").alias("Gender"),
        F.col("c_mktsegment").alias("Department"),
        F.col("o_orderpriority").alias("JobRole"),
        F.col("o_orderstatus").alias("Education"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("EducationLevel"),
        (F.lit(18) + (F.col("c_custkey") % 45).cast("int")).alias("Age"),
        (F.col("o_totalprice") / 50).alias("MonthlyIncome"),
        (F.year("o_orderdate") - 1994).cast("int").alias("YearsAtCompany"),
        (F.col("o_orderkey") % 9).cast("int").alias("YearsSinceLastPromotion"),
        F.col("n").cast("int").alias("NumCompaniesWorked"),
        (F.col("n").cast("int") % 7).alias("TrainingTimesLastYear"),
        (F.lit(1) + qty4).alias("JobSatisfaction"),
        (F.lit(1) + F.col("n").cast("int") % 4).alias("EnvironmentSatisfaction"),
        (F.lit(1) + F.col("mx") % 4).alias("WorkLifeBalance"),
        (F.lit(1) + F.col("mn") % 4).alias("JobInvolvement"),
        F.when(F.col("disc") >= 0.095, 4).otherwise(3).alias("PerformanceRating"),
        F.when(F.col("ret") >= 2, "Yes").when(F.col("ret").isNotNull(), "No").alias("OverTime"),
        F.when(((F.col("ret") >= 2) & (qty4 <= 1)) | (F.col("o_totalprice") < 60000)
               | (F.col("o_orderkey") % 17 == 0), "Yes").otherwise("No").alias("Attrition"),
    )


# The same view for DuckDB (and Spark SQL): used as a CTE by every oracle.
EMPLOYEE_VIEW_SQL = """
SELECT concat('EMP_', CAST(o.o_orderkey AS VARCHAR)) AS EmployeeID,
  CASE WHEN c.c_nationkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS Gender,
  c.c_mktsegment AS Department, o.o_orderpriority AS JobRole, o.o_orderstatus AS Education,
  CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS EducationLevel,
  18 + CAST(c.c_custkey % 45 AS INT) AS Age, o.o_totalprice / 50 AS MonthlyIncome,
  CAST(year(o.o_orderdate) - 1994 AS INT) AS YearsAtCompany,
  CAST(o.o_orderkey % 9 AS INT) AS YearsSinceLastPromotion,
  CAST(l.n AS INT) AS NumCompaniesWorked, CAST(l.n AS INT) % 7 AS TrainingTimesLastYear,
  1 + CAST(l.qty AS INT) % 4 AS JobSatisfaction, 1 + CAST(l.n AS INT) % 4 AS EnvironmentSatisfaction,
  1 + l.mx % 4 AS WorkLifeBalance, 1 + l.mn % 4 AS JobInvolvement,
  CASE WHEN l.disc >= 0.095 THEN 4 ELSE 3 END AS PerformanceRating,
  CASE WHEN l.ret >= 2 THEN 'Yes' WHEN l.ret IS NOT NULL THEN 'No' END AS OverTime,
  CASE WHEN (l.ret >= 2 AND CAST(l.qty AS INT) % 4 <= 1) OR o.o_totalprice < 60000
         OR o.o_orderkey % 17 = 0 THEN 'Yes' ELSE 'No' END AS Attrition
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty, max(l_linenumber) AS mx,
             min(l_linenumber) AS mn, max(l_discount) AS disc,
             sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ret
           FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
"""


def with_emp(sql: str) -> str:
    """Prefix an oracle query with the employee view as CTE ``emp``."""
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH emp AS ({EMPLOYEE_VIEW_SQL}),\n{body[5:]}"
    return f"WITH emp AS ({EMPLOYEE_VIEW_SQL})\n{body}"
