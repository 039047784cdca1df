"""Exact quantiles without gathering a column into one task.

Spark's exact ``percentile`` keeps a value->count map of the whole column in
the final aggregation task, which does not survive a column with billions of
distinct values. ``exact_quantiles`` instead narrows, pass by pass, an
interval that is known to hold the wanted order statistic:

1. one aggregate gives count, min, max and a ``percentile_approx`` sketch per
   column; the sketch values around a wanted level bracket it;
2. an interval that still holds many rows is split at sketch values of its own
   rows, and the rows (and min/max) of each part are counted. A part holds about
   1/``parts`` of the rows, or a single value, whatever the values' spread, so
   every pass shrinks the interval and no limit of passes is needed;
3. once an interval holds at most its share of ``final_max`` rows (all wanted
   quantiles share that budget) or a single value, its distinct values with
   counts are fetched and the rank is read off.

Linear interpolation between the order statistics at floor((n-1)p) and
ceil((n-1)p) matches the usual "type 7" definition (pandas, NumPy, DuckDB
``quantile_cont``, Spark ``percentile``). Every pass scans the (pruned) columns
and has a tiny result. NaN counts as missing, as NULL does.

Per-group quantiles (``grouped_quantiles``) narrow one interval for each
(group, rank): all groups advance in the same pass, over a table of targets that
is joined to the rows. Groups, targets and results stay distributed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = int(math.floor(h))
    hi = int(math.ceil(h))
    return lo, hi, h - lo


# target fields
_COL, _RANK, _A, _B, _BELOW, _COUNT, _VALUE = range(7)


def _locate(targets: list[list], per: dict[int, list], todo: list[int], key: str) -> list[int]:
    """Move each target into the bucket (or value) holding its rank; return
    the targets whose rank was not where the bounds said (sketch miss)."""
    missed = []
    for i in todo:
        t = targets[i]
        got = per.get(i, [])
        if t[_BELOW] is None:
            t[_BELOW] = sum(r["n"] for r in got if r[key] is None)
        rows = sorted((r for r in got if r[key] is not None), key=lambda r: r[key])
        seen = t[_BELOW]
        inside = sum(r["n"] for r in rows)
        if not seen <= t[_RANK] < seen + inside:
            missed.append(i)
            continue
        for r in rows:
            if seen + r["n"] > t[_RANK]:
                if key == "v":
                    t[_VALUE] = r["v"]
                else:
                    t[_A], t[_B], t[_BELOW], t[_COUNT] = r["lo"], r["hi"], seen, r["n"]
                    if r["lo"] == r["hi"]:
                        t[_VALUE] = r["lo"]
                break
            seen += r["n"]
    return missed


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], parts: int = 64,
                    final_max: int = 100_000, sketch_accuracy: int = 1_000) -> dict[str, list[float | None]]:
    """{column: [quantile for each p]} with exact type-7 interpolation.

    NULLs are ignored; a column with no values gives None. The first pass
    also runs a ``percentile_approx`` sketch (rank error at most
    n / ``sketch_accuracy``, bounded memory per task); its values just
    below and above each wanted level bracket the order statistic, so the
    next pass only counts the rows below the bracket and looks at the few
    rows inside it. A bracket that does not hold the rank (never expected)
    falls back to narrowing from [min, max].
    """
    names = list(wanted)
    if not names:
        return {}
    # Work on positional aliases so any column name (dots, spaces) is safe.
    cols = [f"_q{i}" for i in range(len(names))]
    wanted = {a: wanted[n] for a, n in zip(cols, names)}
    src = df.select(*[F.nanvl(F.col("`" + n.replace("`", "``") + "`").cast("double"), F.lit(None).cast("double")).alias(a)
                      for a, n in zip(cols, names)])
    eps = 3.0 / sketch_accuracy
    levels = {c: sorted({min(1.0, max(0.0, p + d)) for p in wanted[c] for d in (-eps, eps)}) for c in cols}
    first = src.agg(*[e for c in cols for e in (
        F.count(c).alias(f"n_{c}"), F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
        F.percentile_approx(c, levels[c], sketch_accuracy).alias(f"q_{c}"))]).collect()[0]
    targets: list[list] = []
    index: dict[tuple[str, int], int] = {}
    for c in cols:
        n = first[f"n_{c}"]
        if not n:
            continue
        sk = dict(zip(levels[c], first[f"q_{c}"]))
        for p in wanted[c]:
            lo_v = sk[min(1.0, max(0.0, p - eps))]
            hi_v = sk[min(1.0, max(0.0, p + eps))]
            for r in set(_ranks(n, p)[:2]):
                if (c, r) not in index:
                    index[(c, r)] = len(targets)
                    if first[f"lo_{c}"] == first[f"hi_{c}"]:
                        targets.append([c, r, first[f"lo_{c}"], first[f"hi_{c}"], 0, n, first[f"lo_{c}"]])
                    else:
                        # below (rows < lo_v) and the count inside are learnt next pass
                        targets.append([c, r, lo_v, hi_v, None, None, None])

    def reset(i: int) -> None:
        c = targets[i][_COL]
        targets[i][_A:_VALUE + 1] = [first[f"lo_{c}"], first[f"hi_{c}"], 0, first[f"n_{c}"], None]

    def small(t: list) -> bool:
        # A sketch bracket spans at most ~8 n / accuracy ranks.
        est = t[_COUNT] if t[_COUNT] is not None else 8 * first[f"n_{t[_COL]}"] / sketch_accuracy
        return est <= final_max / max(1, len(targets))

    def explode_rows(base: DataFrame, items: list) -> DataFrame:
        return base.select(F.explode(F.array(*items)).alias("s")).where(F.col("s").isNotNull())

    cached = None
    while True:
        open_ = [i for i, t in enumerate(targets) if t[_VALUE] is None]
        if not open_:
            break
        wide = [i for i in open_ if not small(targets[i])]
        if cached is None and wide:
            # A refinement pass means at least two more scans: keep the
            # pruned columns instead of recomputing their plan each time.
            cached = src.persist(StorageLevel.MEMORY_AND_DISK)
        base = cached if cached is not None else src
        if wide:
            # Refinement pass: rows in each part of the interval, split at its own sketch values.
            cuts = base.agg(*[F.percentile_approx(F.when(F.col(c).between(a, b), F.col(c)),
                                                  [j / parts for j in range(1, parts)], 4 * parts).alias(f"s{i}")
                              for i in wide for c, _, a, b in [targets[i][:4]]]).first()
            items = []
            for i in wide:
                c, _, a, b = targets[i][:4]
                x = F.col(c)
                at = sorted(set(cuts[f"s{i}"] or []))
                # part 2j + 1 is the value at[j] alone, so a much repeated value is a part of its own
                part = reduce(lambda n, v: n + (x >= v).cast("int") + (x > v).cast("int"), at, F.lit(0))
                inside = F.when(x.between(a, b), F.struct(F.lit(i).alias("t"), part.alias("k"), x.alias("v")))
                if targets[i][_BELOW] is None:
                    inside = F.when(x < a, F.struct(F.lit(i).alias("t"), F.lit(None).cast("int").alias("k"),
                                                    x.alias("v"))).otherwise(inside)
                items.append(inside)
            rows = (explode_rows(base, items).groupBy(F.col("s.t").alias("t"), F.col("s.k").alias("k"))
                    .agg(F.count(F.lit(1)).alias("n"), F.min("s.v").alias("lo"), F.max("s.v").alias("hi"))
                    .collect())
            per: dict[int, list] = {}
            for r in rows:
                per.setdefault(r["t"], []).append(r)
            for i in _locate(targets, per, wide, "k"):
                reset(i)
            continue
        # Final pass: distinct values (with counts) inside each small interval.
        items = []
        for i in open_:
            c, _, a, b = targets[i][:4]
            x = F.col(c)
            inside = F.when(x.between(a, b), F.struct(F.lit(i).alias("t"), x.alias("v")))
            if targets[i][_BELOW] is None:
                inside = F.when(x < a, F.struct(F.lit(i).alias("t"), F.lit(None).cast("double").alias("v"))
                                ).otherwise(inside)
            items.append(inside)
        rows = (explode_rows(base, items).groupBy(F.col("s.t").alias("t"), F.col("s.v").alias("v"))
                .agg(F.count(F.lit(1)).alias("n")).collect())
        per = {}
        for r in rows:
            per.setdefault(r["t"], []).append(r)
        for i in _locate(targets, per, open_, "v"):
            reset(i)
    if cached is not None:
        cached.unpersist()

    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = first[f"n_{c}"]
        vals: list[float | None] = []
        for p in wanted[c]:
            if not n:
                vals.append(None)
                continue
            lo, hi, frac = _ranks(n, p)
            a = targets[index[(c, lo)]][_VALUE]
            b = targets[index[(c, hi)]][_VALUE]
            vals.append(a if lo == hi else a + frac * (b - a))
        out[c] = vals
    return {n: out[a] for a, n in zip(cols, names)}


def exact_quantile(df: DataFrame, column: str, p: float, **kw) -> float | None:
    return exact_quantiles(df, {column: [p]}, **kw)[column][0]


# ---- per group ----

def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], final_max: int = 100_000,
                      sketch_accuracy: int = 1_000, salts: int = 8) -> DataFrame:
    """Per group (NULL keys are groups): the keys and ``q0``, ``q1``, ... with exact type-7 interpolation.

    Each (group, rank) has an interval [a, b] of sketch values that brackets it.
    A pass counts, for all targets at once, the rows below a, equal to a, inside
    and equal to b; a rank in a run of equal values is found, any other
    one gets a narrower interval from a sketch of the rows strictly inside, which
    are at most about 8 / ``sketch_accuracy`` of those before, whatever the values'
    spread. An interval with at most ``final_max`` rows is finished by its distinct
    values and their counts, ranked by a window over that many rows. A rank
    that a bracket misses (sketches are not guaranteed) starts from [min, max].

    Every aggregate is partial before its shuffle. Rows meet their group's targets
    by a join on the key and a salt of the row, so a hot group is dealt over
    ``salts`` tasks where the target table is too large to be broadcast. The
    state between passes is a table in the shared folder. NaN and NULL are missing;
    a group without values has NULL.
    """
    from hrsight.session import scratch_path

    spark = df.sparkSession
    ks = [f"_k{i}" for i in range(len(keys))]
    x = F.col("`" + column.replace("`", "``") + "`").cast("double")
    src = df.select(*[F.col("`" + k.replace("`", "``") + "`").alias(a) for k, a in zip(keys, ks)],
                    F.nanvl(x, F.lit(None).cast("double")).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)

    def kept(frame: DataFrame) -> DataFrame:
        path = scratch_path(spark, f"quantiles-{uuid.uuid4().hex}")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    eps = 3.0 / sketch_accuracy
    levels = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    groups = kept(src.groupBy(*ks).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                       F.percentile_approx("x", levels, sketch_accuracy).alias("s")))

    def at(p: float):
        return F.col("s")[levels.index(min(1.0, max(0.0, p)))]

    # one target for each group, level and side; "inside" is the number of rows that the interval may hold
    sides = [F.struct(F.lit(2 * i + up).alias("t"), at(p - eps).alias("a"), at(p + eps).alias("b"),
                      (F.ceil if up else F.floor)((F.col("n") - 1) * F.lit(float(p))).cast("bigint").alias("rank"))
             for i, p in enumerate(probs) for up in (0, 1)]
    state = kept(groups.where("n > 0").select(*ks, "n", "lo", "hi", F.explode(F.array(*sides)).alias("e"))
                 .select(*ks, "n", "lo", "hi", "e.*", (F.col("n") * (8.0 / sketch_accuracy)).alias("inside"),
                         F.lit(None).cast("double").alias("value")))
    salt = F.pmod(F.xxhash64("x"), F.lit(salts)).cast("int")

    def met(targets: DataFrame) -> DataFrame:
        """(keys, target, x) of the rows up to each target's b."""
        lists = targets.groupBy(*ks).agg(F.collect_list(F.struct("t", "a", "b")).alias("ts")) \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = src.where("x IS NOT NULL").withColumn("salt", salt)
        on = [rows[k].eqNullSafe(lists[k]) for k in ks] + [rows["salt"] == lists["salt"]]
        return (rows.join(lists, on).select(*[rows[k] for k in ks], "x", F.explode("ts").alias("e"))
                .where(F.col("x") <= F.col("e.b")).select(*ks, "x", "e.t", "e.a", "e.b"))

    def back(frame: DataFrame, other: DataFrame, how: str) -> DataFrame:
        """Join on keys (null-safe) and target."""
        named = other.select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("t").alias("t_"), *[c for c in other.columns if c not in (*ks, "t")])
        on = [frame[k].eqNullSafe(named[f"{k}_"]) for k in ks] + [frame["t"] == named["t_"]]
        return frame.join(named, on, how).drop("t_", *[f"{k}_" for k in ks])

    while True:
        open_ = state.where("value IS NULL")
        wide = open_.where(F.col("inside") > final_max)
        if not wide.isEmpty():
            strict = F.when((F.col("x") > F.col("a")) & (F.col("x") < F.col("b")), F.col("x"))
            seen = met(wide).groupBy(*ks, "t").agg(
                F.sum((F.col("x") < F.col("a")).cast("bigint")).alias("below"), F.sum((F.col("x") == F.col("a")).cast("bigint")).alias("at_a"),
                F.count(strict).alias("within"), F.sum(((F.col("x") == F.col("b")) & (F.col("a") < F.col("b"))).cast("bigint")).alias("at_b"),
                F.percentile_approx(strict, [j / 256 for j in range(257)], 2 * sketch_accuracy).alias("cuts"))
            got = back(state, seen, "left")
            first = F.col("rank") - F.col("below")
            inner = first - F.col("at_a")
            level = inner / F.greatest(F.col("within"), F.lit(1)) * 256
            missed = (first < 0) | (inner >= F.col("within") + F.col("at_b"))
            new = F.when(F.col("below").isNull(), F.struct("a", "b", "inside", "value")) \
                .when(missed, F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("n").cast("double").alias("inside"),
                                       F.lit(None).cast("double").alias("value"))) \
                .when(inner < 0, F.struct("a", "b", "inside", F.col("a").alias("value"))) \
                .when(inner >= F.col("within"), F.struct("a", "b", "inside", F.col("b").alias("value"))) \
                .otherwise(F.struct(
                    F.get("cuts", F.greatest(F.floor(level).cast("int") - 1, F.lit(0))).alias("a"),
                    F.get("cuts", F.least(F.floor(level).cast("int") + 2, F.lit(256))).alias("b"),
                    (F.col("within") / 64).alias("inside"), F.lit(None).cast("double").alias("value")))
            state = kept(got.withColumn("e", new).select(*ks, "n", "lo", "hi", "t", F.col("e.a").alias("a"), F.col("e.b").alias("b"), "rank",
                                                         F.col("e.inside").alias("inside"), F.col("e.value").alias("value")))
            continue
        if open_.isEmpty():
            break
        # the rows below a as one row, each value in [a, b] as one
        value = F.when(F.col("x") >= F.col("a"), F.col("x"))
        counts = met(open_).groupBy(*ks, "t", value.alias("v")).agg(F.count(F.lit(1)).alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*ks, "t").orderBy(F.col("v").asc_nulls_first()))
        ranked = back(open_.select(*ks, "t", "rank"), counts.withColumn("upto", upto), "inner")
        found = ranked.where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("m") <= F.col("rank")) & F.col("v").isNotNull()) \
            .select(*ks, "t", F.col("v").alias("found"))
        state = kept(back(state, found, "left").select(
            *ks, "n", "t", "rank", F.coalesce("value", "found").alias("value"), "lo", "hi",
            F.lit(None).cast("double").alias("inside"), F.col("lo").alias("a"), F.col("hi").alias("b"))
            .withColumn("inside", F.when(F.col("value").isNull(), F.col("n").cast("double"))))
    src.unpersist()

    def side(i: int):
        return F.max(F.when(F.col("t") == i, F.col("value")))

    made = state.groupBy(*ks, "n").agg(*[e for i in range(len(probs)) for e in (side(2 * i).alias(f"l{i}"), side(2 * i + 1).alias(f"u{i}"))])
    levels_ = [((F.col("n") - 1) * F.lit(float(p))) for p in probs]
    quantiles = made.select(*[F.col(k).alias(f"{k}_") for k in ks], *[
        (F.col(f"l{i}") + (h - F.floor(h)) * (F.col(f"u{i}") - F.col(f"l{i}"))).alias(f"q{i}") for i, h in enumerate(levels_)])
    on = [groups[k].eqNullSafe(quantiles[f"{k}_"]) for k in ks]
    return groups.select(*ks).join(quantiles, on, "left").select(
        *[F.col(k).alias(n) for k, n in zip(ks, keys)], *[f"q{i}" for i in range(len(probs))])
