import pyspark.sql.functions as F

from hrsight.operators import profile, sketches


def test_union_of_states_counts_shared_values_once(spark):
    """Twelve uploads that overlap, three of them holding a third of all rows; states written and read back."""
    import uuid

    from hrsight.session import scratch_path
    df = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("u"), (F.col("id") % 11).cast("string"))).alias("upload"),
        (F.col("id") % 20000).alias("person"), (F.col("id") % 7).cast("string").alias("d.ept"),
        F.when(F.col("id") < 0, 1).alias("none"))
    path = scratch_path(spark, f"states-{uuid.uuid4().hex}")
    sketches.distinct_states(df, by="upload").write.parquet(path)
    states = spark.read.parquet(path)
    assert states.count() == 12 * 3
    got = {r["column"]: r for r in sketches.distinct_counts(states).collect()}
    assert got["person"]["low"] <= 20000 <= got["person"]["high"] and got["person"]["n"] == 60000
    assert abs(got["person"]["n_distinct"] - 20000) <= 3 * sketches.relative_error() * 20000
    assert (got["d.ept"]["n_distinct"], got["none"]["n_distinct"], got["none"]["n"]) == (7, 0, 0)
    # two steps give what one gives
    again = {r["column"]: r["n_distinct"] for r in sketches.distinct_counts(
        sketches.merged_states(states, "upload").unionByName(states.select("upload", "column", "sketch", F.lit(0).cast("long").alias("n")))).collect()}
    assert again == {c: r["n_distinct"] for c, r in got.items()}


def test_each_upload_and_empty(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, None)], "upload string, v string")
    got = {r["upload"]: r["n_distinct"] for r in sketches.distinct_counts(sketches.distinct_states(df, ["v"], "upload"), "upload").collect()}
    assert got == {"a": 2, "b": 1, None: 0}
    assert sketches.distinct_counts(sketches.distinct_states(df.limit(0), ["v"], "upload"), "upload").count() == 0


def test_profile_option(spark):
    df = spark.range(30000).select((F.col("id") % 12000).cast("string").alias("v"), F.lit("k").alias("w"))
    exact = {(r["column"], r["rank"]): r for r in profile.categorical_profile(df).collect()}
    near = {(r["column"], r["rank"]): r for r in profile.categorical_profile(df, distinct="approx").collect()}
    assert set(exact) == set(near) and near["w", 1]["unique_count"] == 1
    for k, r in exact.items():
        assert (r["value"], r["n"]) == (near[k]["value"], near[k]["n"])
        assert abs(near[k]["unique_count"] - r["unique_count"]) <= 3 * sketches.relative_error() * r["unique_count"]


def test_overview_option(spark):
    from conftest import hr_frame, to_spark

    from hrsight.operators import describe
    df = to_spark(spark, hr_frame(seed=4))
    assert describe.overview(df, distinct="approx").collect() == describe.overview(df).collect()
    key = lambda r: str(r["Gender"])
    assert sorted(describe.overview(df, by="Gender", distinct="approx").collect(), key=key) == \
        sorted(describe.overview(df, by="Gender").collect(), key=key)
