"""Quality rules: text statistics, and a decision list learned by sequential covering.

Statistics are built-in SQL expressions over whole texts, one row at a time and
without a shuffle. The list is learned from labelled statistics: a rule grows by
the threshold condition with the largest FOIL gain, is pruned backwards on rows
held out for that, and the rows that it covers are taken away before the next
rule grows. Every step is an aggregation over the labelled rows' threshold cells;
the driver sees counts for each (statistic, cell) only. The result is an ordered
list of conjunctions, applied as one `CASE WHEN` expression.

Defined results: null, empty and blank texts have all statistics 0; without
labelled rows of both kinds the list is empty and only the base rules decide;
several labels of one document count as the lowest; repeated rows are returned
repeatedly; rows with a null id are judged as others and never learned from.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hrsight.llm.native import grams, words
from hrsight.llm.tasks import saved

WINDOW = 5


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, text_hash (xxhash64 of the text) and its counts (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, r"^[\x20\x09-\x0D]+", "")) > 0)
    step = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).select(
        "id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"), lines.alias("lines"), gone(r"[#*$%&|<>]+").alias("n_symbols"),
        gone("!+").alias("n_bangs"), gone("[A-Z]+").alias("n_upper"))
    step = step.select("*", grams(F.col("w"), WINDOW).alias("g"))
    # (fingerprint, place), only where a window occurs twice
    step = step.select("*", F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("s"))
    twice = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    step = step.select("*", F.sort_array(F.transform(twice, lambda x: x["p"])).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    return step.select(
        F.col("id").alias(id_col), "text_hash", F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
        "n_bangs", "n_upper")


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < 10) | (F.col("n_repeat_words") * 100 > n * 20)


def features() -> dict[str, Column]:
    """Statistics that rules may test, all doubles."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "bangs": share("n_bangs", "word_chars"),
        "upper": share("n_upper", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
    }


class Rule:
    """A conjunction of (feature, '>=' or '<', threshold)."""

    def __init__(self, conditions):
        self.conditions = conditions

    def column(self) -> Column:
        made = features()
        tests = [made[f] >= t if op == ">=" else made[f] < t for f, op, t in self.conditions]
        return reduce(lambda a, b: a & b, tests)

    def __repr__(self):
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", cells: int = 32,
          max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.95, min_covered: int = 5,
          sample: int = 200_000) -> list[Rule]:
    """Rules for rejecting (label 0), from at most `sample` labelled rows (those with the smallest id hash)."""
    made = features()
    truth = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("y")) \
        .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    rows = (stats.withColumnRenamed(id_col, "id").join(truth, "id")
            .where(~base_failed())
            .select(F.crc32(F.col("id").cast("string")).alias("c"), "id", "y", *[v.alias(k) for k, v in made.items()])
            .orderBy("c", "id").limit(sample))
    rows = saved(rows, "labelled")
    cuts = rows.agg(*[F.percentile(k, F.array(*[F.lit(i / cells) for i in range(1, cells)])).alias(k) for k in made]).first()
    thresholds = {k: sorted({v for v in (cuts[k] or [])}) for k in made}

    def cell(k):  # how many thresholds the value reaches
        return reduce(lambda a, t: a + (F.col(k) >= t).cast("int"), thresholds[k], F.lit(0))

    left = saved(rows.select(*[cell(k).alias(k) for k in made], F.expr("c % 3 = 0").alias("pruning"),
                             (F.col("y") == 0).cast("bigint").alias("pos"), (F.col("y") != 0).cast("bigint").alias("neg"))
                 .groupBy(*made, "pruning").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "cells")

    def test(conditions):
        return reduce(lambda a, b: a & b, [F.col(f) >= j if op == ">=" else F.col(f) < j for f, op, j in conditions], F.lit(True))

    def gain(p, n, p0, n0):
        return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0

    rules: list[Rule] = []
    while len(rules) < max_rules:
        conditions: list[tuple] = []
        while len(conditions) < max_conditions:
            counts = (left.where(~F.col("pruning")).where(test(conditions))
                      .select(F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(k).alias("j")) for k in made])).alias("e"),
                              "pos", "neg").groupBy("e.f", "e.j").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect())
            of = {k: [[0, 0] for _ in range(len(thresholds[k]) + 1)] for k in made}
            for r in counts:
                of[r.f][r.j] = [r.pos, r.neg]
            any_f = next(iter(of.values()))
            p0, n0 = sum(x[0] for x in any_f), sum(x[1] for x in any_f)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k, c in of.items():
                for j in range(1, len(c)):
                    hi = sum(x[0] for x in c[j:]), sum(x[1] for x in c[j:])
                    for op, (p, n) in ((">=", hi), ("<", (p0 - hi[0], n0 - hi[1]))):
                        best = max(best, (round(gain(p, n, p0, n0), 9), (k, op, j)), key=lambda x: x[0])
            if best[1] is None:
                break
            conditions.append(best[1])
        if not conditions:
            break
        ends = [test(conditions[: i + 1]) for i in range(len(conditions))]
        sums = left.agg(*[F.sum(F.when(e & F.col("pruning"), F.col(c))).alias(f"{c}{i}")
                          for i, e in enumerate(ends) for c in ("pos", "neg")],
                        *[F.sum(F.when(e, F.col(c))).alias(f"all_{c}{i}") for i, e in enumerate(ends) for c in ("pos", "neg")]).first()
        worth = []
        for i in range(len(conditions)):
            p, n = sums[f"pos{i}"] or 0, sums[f"neg{i}"] or 0
            worth.append(((p - n) / (p + n) if p + n else -1.0, -i))
        keep = 1 - max(worth)[1]
        p, n = sums[f"all_pos{keep - 1}"] or 0, sums[f"all_neg{keep - 1}"] or 0
        if max(worth)[0] <= 0 or p < min_covered or p < min_precision * (p + n):
            break
        rules.append(Rule([(f, op, thresholds[f][j - 1]) for f, op, j in conditions[:keep]]))
        left = left.where(~test(conditions[:keep]))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, as one ordered conditional; null if none does."""
    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules))):
        out = F.when(r.column(), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per input row: id, the counts, base_failed, rule (number of the rejecting rule), kept."""
    stats = saved(statistics(docs, id_col, text_col), "statistics")
    rules = learn(stats, labels, id_col, **options)
    out = stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    out._hrsight_rules = rules
    return out


def op6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(
        F.crc32(F.col("doc_id").cast("string")) % 5 != 0)  # the rest stays unseen, to measure on
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "kept", "rule")
