"""Column expressions shared by the operators.

All of them are built-in Spark SQL functions, so they stay inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from hrsight.roles import Roles

# Strings read as "left the company" (case-insensitive).
LEFT_TOKENS: tuple[str, ...] = ("yes", "1", "true", "left")
# Strings read as "works overtime" (case-insensitive).
TRUTHY_TOKENS: tuple[str, ...] = ("yes", "1", "true")


def col(name: str) -> Column:
    """Column by its exact name (dots, spaces and backticks in CSV headers
    are not read as struct access)."""
    return F.col("`" + name.replace("`", "``") + "`")


def label_flag(df: DataFrame, roles: Roles) -> Column | None:
    """Boolean "left" flag, never NULL (a NULL label counts as stayed).

    String labels: lower-case text in LEFT_TOKENS. Numeric and boolean
    labels: equal to 1. None when the frame has no label column.
    """
    name = roles.label_col(df)
    if name is None:
        return None
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, StringType):
        cond = F.lower(c).isin(*LEFT_TOKENS)
    elif isinstance(dtype, BooleanType):
        cond = c
    elif isinstance(dtype, NumericType):
        cond = c == 1
    else:
        cond = F.lower(c.cast("string")).isin(*LEFT_TOKENS)
    return F.coalesce(cond, F.lit(False))


def truthy(c: Column) -> Column:
    """Overtime-style yes test; NULL input gives NULL (use ``not_truthy``
    for the complement that keeps NULL rows)."""
    return F.lower(c.cast("string")).isin(*TRUTHY_TOKENS)


def not_truthy(c: Column) -> Column:
    """Complement of ``truthy`` that counts NULL as not-yes."""
    return ~F.coalesce(truthy(c), F.lit(False))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (NULL counts as false)."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def pct(k: Column, n: Column, digits: int = 2) -> Column:
    """round_half_even(k / n * 100, digits); 0.0 when n is 0.

    The operation order k / n * 100 is kept on purpose: 100 * k / n rounds
    differently for some k, n.
    """
    return F.bround(F.coalesce(F.try_divide(k.cast("double"), n.cast("double")), F.lit(0.0))
                    * F.lit(100.0), digits)


def rate(flag: Column | None, where: Column | None = None) -> Column:
    """Attrition rate (percent, 2 dp) of the rows selected by ``where``.

    The denominator is every selected row, NULL labels included; an empty
    selection or a missing label column gives 0.0.
    """
    if flag is None:
        return F.lit(0.0)
    if where is None:
        return pct(count_if(flag), F.count(F.lit(1)))
    return pct(count_if(where & flag), count_if(where))


def rnd(c: Column, digits: int) -> Column:
    return F.bround(c.cast("double"), digits)


def clamp(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """NULL-preserving clamp (``greatest``/``least`` skip NULLs)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(out.cast("double"))


def mean_of(parts: Iterable[Column]) -> Column:
    """Mean of the non-NULL parts; NULL when there are none."""
    parts = list(parts)
    if not parts:
        return F.lit(None).cast("double")
    arr = F.filter(F.array(*[p.cast("double") for p in parts]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(arr).cast("double"))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def format_decimals(c: Column, decimals: int = 2) -> Column:
    """Round anything numeric-looking to ``decimals``; pass other text on."""
    num = c.cast("string").try_cast("double")
    return F.coalesce(F.bround(num, decimals).cast("string"), c.cast("string"))


def title_key(c: Column) -> Column:
    """snake_case key -> "Title Case" label."""
    return F.initcap(F.regexp_replace(c, "_", " "))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in skip]


def group_cols(by: str | Iterable[str] | None) -> list[str]:
    if by is None:
        return []
    if isinstance(by, str):
        return [by]
    return list(by)
