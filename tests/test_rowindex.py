import pyspark.sql.functions as F
from conftest import hr_frame, to_spark

from hrsight.operators import lookup, rowindex


def pairs(df, by="index"):
    return sorted((r[by], *[r[c] for c in df.columns if c != by]) for r in df.collect())


def test_dense_and_equal_after_recomputation(spark):
    """A third of all rows are one row; other partitions and another order of rows give the same numbers."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("r"), (F.col("id") % 2500).cast("string"))).alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 2500).alias("b"))
    one = pairs(rowindex.with_index(df.repartition(5)))
    two = pairs(rowindex.with_index(df.orderBy(F.rand(3)).repartition(11)))
    assert one == two and [r[0] for r in one] == list(range(6000))


def test_order_is_of_the_chosen_columns(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 500).alias("other"))
    a = {r["id"]: r["index"] for r in rowindex.with_index(df, columns=["id"]).collect()}
    b = {r["id"]: r["index"] for r in rowindex.with_index(df.withColumn("other", F.lit(1)), columns=["id"]).collect()}
    assert a == b and sorted(a.values()) == list(range(500))


def test_odd_columns(spark):
    """Names with dots and backticks, own columns of the helper's names, binary, maps, nulls, equal texts cut differently."""
    df = spark.sql("""
        SELECT * FROM VALUES ('ab', 'c', map('x', 1, 'y', 2), X'00FF', 1), ('a', 'bc', map('y', 2, 'x', 1), X'00FF', 1),
          (NULL, '', NULL, NULL, 1), ('', NULL, NULL, X'', 2), (NULL, NULL, NULL, NULL, NULL)
        AS t(`a.b`, `_digest`, `m``x`, `_n`, `_row`)""")
    out = rowindex.with_index(df, "no")
    assert out.columns == [*df.columns, "no"] and sorted(r["no"] for r in out.collect()) == [0, 1, 2, 3, 4]
    digests = df.select(rowindex.content_digest(df).alias("d")).distinct().count()
    assert digests == 5
    assert rowindex.with_index(df.limit(0)).count() == 0
    again = rowindex.with_index(out, "no")
    assert again.columns == out.columns and sorted(r["no"] for r in again.collect()) == [0, 1, 2, 3, 4]


def test_fallback_ids(spark):
    df = to_spark(spark, hr_frame(seed=8)).drop("EmployeeID")
    a = {r["employee_id"]: (r["Age"], r["MonthlyIncome"]) for r in lookup.with_employee_id(df).collect()}
    b = {r["employee_id"]: (r["Age"], r["MonthlyIncome"]) for r in lookup.with_employee_id(df.repartition(7)).collect()}
    assert a == b and set(a) == {f"Employee_{i}" for i in range(len(a))}
