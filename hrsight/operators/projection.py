"""Headcount and attrition projection per group (W1) and its chart series.

Month m of the projection, for a group of n0 people with attrition rate r0
(percent, 2 dp):

    rate_m       = clamp(max(5, r0 * 0.98^m + noise_m), 0, 50)
    departures_m = floor(size_{m-1} * rate_m / 100 / 12)
    hiring_m     = departures_m + floor(n0 * 0.02 / 12)
    size_m       = size_{m-1} - departures_m + hiring_m

Hiring always replaces departures plus a constant, so size_m is
n0 + m * floor(n0 * 0.02 / 12) in closed form: the whole table is one
``explode(sequence(1, periods))`` over the per-group stats row, all groups
in parallel, no recursion. The noise is off by default; with
``noise_sd > 0`` it is a normal draw per (seed, group, month) from
``functions/draws.py``, so reruns, recomputed partitions and another SQL
engine give the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hrsight.functions import draws
from hrsight.functions.exprs import col, group_cols, label_flag, rate, rnd
from hrsight.roles import Roles

# Projection constants.
MONTHLY_DECAY = 0.98
RATE_FLOOR, RATE_MIN, RATE_MAX = 5.0, 0.0, 50.0
GROWTH = 0.02


#: Stream of the noise draws; months are part of their key.
NOISE_STREAM = 0


def noise_key(keys: Iterable[str]) -> str:
    """SQL text (both dialects) of a noise draw's key: the month and the group's values; each is led by its length, and
    groups with a NULL don't occur."""
    names = ["`" + k.replace("`", "``") + "`" for k in keys]
    parts = [f"CAST(length(CAST({k} AS STRING)) AS STRING), ':', CAST({k} AS STRING)" for k in names]
    return f"concat(CAST(month AS STRING), ':', {', '.join(parts) or repr('')})"


def projection(df: DataFrame, roles: Roles | None = None, by: str | Iterable[str] | None = None,
               periods: int = 12, noise_sd: float = 0.0, seed: int = 42) -> DataFrame:
    roles = Roles.of(roles)
    keys = group_cols(by)
    flag = label_flag(df, roles)
    base = df
    for k in keys:
        base = base.where(col(k).isNotNull())
    agg = [F.count(F.lit(1)).alias("n0"), rate(flag).alias("r0")]
    named = [col(k) for k in keys]
    stats = base.groupBy(*named).agg(*agg) if keys else base.agg(*agg)
    m = F.col("month")
    raw, u = F.col("r0") * F.pow(F.lit(MONTHLY_DECAY), m.cast("double")), "NULL"
    if noise_sd > 0:
        u = draws.uniform(noise_key(keys), NOISE_STREAM, seed)
        raw = raw + F.expr(draws.normal("_u", 0.0, noise_sd))
    r = F.least(F.greatest(F.greatest(F.lit(RATE_FLOOR), raw), F.lit(RATE_MIN)), F.lit(RATE_MAX))
    step = F.floor(F.col("n0") * GROWTH / 12.0).cast("long")
    prev = F.col("n0") + (m - 1) * F.col("_step")
    departures = F.floor(prev * F.col("_r") / 100.0 / 12.0).cast("long")
    return (stats.select(*named, "n0", "r0", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("month"))
            .withColumn("_u", F.expr(u)).withColumn("_step", step).withColumn("_r", r)
            .withColumn("projected_departures", departures)
            .select(*named, "month",
                    rnd(F.col("_r"), 2).alias("projected_attrition_rate"),
                    "projected_departures",
                    (F.col("n0") + m * F.col("_step")).alias("projected_size"),
                    (F.col("projected_departures") + F.col("_step")).alias("hiring_needed")))


def projection_series(proj: DataFrame, by: str | Iterable[str] | None = None) -> DataFrame:
    """Chart series of a projection: (series, x = "M<month>", month, y) for the
    attrition rate and the workforce size."""
    keys = group_cols(by)
    x = F.concat(F.lit("M"), F.col("month").cast("string"))
    return proj.select(*keys, "month", x.alias("x"), F.explode(F.array(
        F.struct(F.lit("Attrition %").alias("series"), F.col("projected_attrition_rate").cast("double").alias("y")),
        F.struct(F.lit("Workforce Size").alias("series"), F.col("projected_size").cast("double").alias("y")),
    )).alias("s")).select(*keys, "s.series", "x", "month", "s.y")
