"""Preview and search.

Both are top-k reads: ``orderBy(id).limit(k)`` plans as
TakeOrderedAndProject, so each task keeps only k rows and the driver merges
k x tasks rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.functions.exprs import col
from hrsight.operators.rowindex import with_index
from hrsight.roles import SEARCH_COLUMNS, Roles


def preview(df: DataFrame, roles: Roles | None = None, n: int = 50, as_text: bool = False) -> DataFrame:
    """First ``n`` rows in id order (any order is arbitrary in Spark, so the
    id gives a stable one). ``as_text`` renders every value as text with
    NULL as the empty string, as a display grid wants it."""
    roles = Roles.of(roles)
    idc = roles.id_col(df)
    out = df.orderBy(*([F.col(f"`{idc}`")] if idc else [F.col(f"`{c}`") for c in df.columns])).limit(n)
    if as_text:
        out = out.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    return out


def search_column(df: DataFrame) -> str | None:
    return next((c for c in SEARCH_COLUMNS if c in df.columns), None)


def employee_search(df: DataFrame, query: str, roles: Roles | None = None, limit: int = 20,
                    regex: bool = False) -> DataFrame:
    """Rows whose first present search column (id, number, names) contains
    ``query`` case-insensitively; ``regex=True`` treats it as a pattern.
    At most ``limit`` rows, in id order."""
    roles = Roles.of(roles)
    col = search_column(df)
    if col is None or not query:
        return df.limit(0)
    text = F.lower(F.col(f"`{col}`").cast("string"))
    q = query.lower()
    cond = text.rlike(q) if regex else text.contains(q)
    idc = roles.id_col(df) or col
    return df.where(F.coalesce(cond, F.lit(False))).orderBy(F.col(f"`{idc}`")).limit(limit)


def department_search(df: DataFrame, query: str, roles: Roles | None = None) -> DataFrame:
    """Distinct departments whose name contains ``query`` (literal,
    case-insensitive)."""
    roles = Roles.of(roles)
    dept = roles.col(df, "department")
    if dept is None or not query:
        return df.sparkSession.createDataFrame([], "department string")
    return (df.select(col(dept).cast("string").alias("department")).where(F.col("department").isNotNull())
            .distinct().where(F.lower("department").contains(query.lower())).orderBy("department"))


def with_employee_id(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Add ``employee_id``: the id column, else ``EmployeeNumber``, else
    ``Employee_<index>`` with the dense row number of ``rowindex.with_index``
    (kept as ``index``, or taken from a column of that name)."""
    roles = Roles.of(roles)
    idc = roles.id_col(df)
    if idc is not None:
        return df.withColumn("employee_id", F.col(f"`{idc}`").cast("string"))
    numbered = df if "index" in df.columns else with_index(df)
    return numbered.withColumn("employee_id", F.concat(F.lit("Employee_"), F.col("index").cast("string")))
