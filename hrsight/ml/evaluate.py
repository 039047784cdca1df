"""Classification metrics on a scored frame.

Accuracy and weighted precision / recall / F1 come from the confusion
counts (a 2x2 aggregate); zero divisions give 0. The AUC is exact: Spark's
binary evaluator with no down-sampling sorts the distinct scores in a
distributed way (range partitioning plus per-partition offsets), so it
never gathers the scores in one task. ROC points are one for each distinct
score, with running sums by range partition.
"""

from __future__ import annotations

import uuid

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hrsight.ml.prep import LABEL
from hrsight.session import scratch_path

PROB = "p_left"


def with_probability(scored: DataFrame, prob_col: str = "probability") -> DataFrame:
    return scored.withColumn(PROB, vector_to_array(F.col(prob_col)).getItem(1))


def confusion(scored: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted)."""
    return (scored.groupBy(F.col(label).cast("int").alias("actual"),
                           F.col(prediction).cast("int").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1 over
    the classes present in the actual labels."""
    c = cm.groupBy().agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("correct"),
        *[F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name) for name, cond in (
            ("tp1", (F.col("actual") == 1) & (F.col("predicted") == 1)),
            ("tp0", (F.col("actual") == 0) & (F.col("predicted") == 0)),
            ("a1", F.col("actual") == 1), ("a0", F.col("actual") == 0),
            ("p1", F.col("predicted") == 1), ("p0", F.col("predicted") == 0))])

    def div(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    prec = {k: div(F.col(f"tp{k}"), F.col(f"p{k}")) for k in (0, 1)}
    rec = {k: div(F.col(f"tp{k}"), F.col(f"a{k}")) for k in (0, 1)}
    f1 = {k: div(F.lit(2.0) * prec[k] * rec[k], prec[k] + rec[k]) for k in (0, 1)}
    w = {k: div(F.col(f"a{k}"), F.col("total")) for k in (0, 1)}

    def weighted(m):
        return w[0] * m[0] + w[1] * m[1]

    return c.select(div(F.col("correct"), F.col("total")).alias("accuracy"),
                    weighted(prec).alias("precision"), weighted(rec).alias("recall"),
                    weighted(f1).alias("f1_score"))


def auc(scored: DataFrame, score: str = PROB, label: str = LABEL,
        counts: tuple[int, int] | None = None) -> float | None:
    """Exact area under the ROC curve (ties count one half); None when one
    class is absent. ``counts`` = (positives, rows) when already known."""
    if counts is None:
        r = scored.agg(F.sum(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("n")).collect()[0]
        counts = (r["pos"] or 0, r["n"])
    pos, n = counts
    if not n or pos in (0, n):
        return None
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC",
                                       numBins=0)
    return ev.evaluate(scored.select(F.col(score).cast("double").alias(score), F.col(label).cast("double")))


def roc_points(scored: DataFrame, score: str = PROB, label: str = LABEL) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, highest first, after (inf, 0, 0).

    The running sums are distributed: scores are range-partitioned, each
    partition sums its own, and gets the totals of the partitions before it
    (one row for each partition)."""
    spark = scored.sparkSession
    per = (scored.groupBy(F.col(score).cast("double").alias("threshold"))
           .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
           .repartitionByRange(F.desc("threshold")).withColumn("part", F.spark_partition_id()))
    path = scratch_path(spark, f"roc-{uuid.uuid4().hex}")
    per.write.parquet(path)  # the partition numbers must not change between reads
    per = spark.read.parquet(path)
    w = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = per.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("tp0"),
                         F.coalesce(F.sum(F.col("n") - F.col("pos")).over(before), F.lit(0)).alias("fp0"),
                         F.sum("pos").over(every).alias("P"), F.sum(F.col("n") - F.col("pos")).over(every).alias("N"))
    cum = per.select("part", "threshold", F.sum("pos").over(w).alias("tp"), F.sum(F.col("n") - F.col("pos")).over(w).alias("fp"))
    pts = cum.join(F.broadcast(parts), "part").select(
        "threshold", F.coalesce(F.try_divide(F.col("fp") + F.col("fp0"), F.col("N")), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide(F.col("tp") + F.col("tp0"), F.col("P")), F.lit(0.0)).alias("tpr"))
    origin = spark.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts).orderBy(F.desc("threshold"))
