"""Dataset profile and correlation matrix.

Each profile is a single aggregate over all columns (one scan), turned into
one row per column afterwards; no per-column jobs. The top values per
categorical column use ``row_number`` over (column) on the already counted
(column, value) rows: Spark plans a partial ``WindowGroupLimit`` before the
shuffle, so each map task forwards at most k rows per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from hrsight.functions import heavy
from hrsight.functions.exprs import categorical_columns, count_if, numeric_columns, pct, rnd
from hrsight.functions.quantiles import exact_quantiles
from hrsight.operators import sketches


def _stack(items, names) -> "F.Column":
    return F.explode(F.array(*[F.struct(*[v.alias(n) for v, n in zip(item, names)]) for item in items]))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column: position, type, NULL count and percent (2 dp), with the
    table's row and column counts."""
    cols = df.columns
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, position int, dtype string, null_count long, null_pct double, "
                "rows long, columns int")
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[count_if(F.col(f"`{c}`").isNull()).alias(f"_z{i}") for i, c in enumerate(cols)])
    items = [(F.lit(c), F.lit(i), F.lit(df.schema[c].dataType.simpleString()), F.col(f"_z{i}"))
             for i, c in enumerate(cols)]
    return (agg.select(F.col("_n"), _stack(items, ["column", "position", "dtype", "null_count"]).alias("s"))
            .select("s.column", "s.position", "s.dtype", "s.null_count",
                    pct(F.col("s.null_count"), F.col("_n")).alias("null_pct"),
                    F.col("_n").alias("rows"), F.lit(len(cols)).alias("columns")))


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: mean, sample std, min, max, exact median (2 dp);
    NULL when the column has no values. Booleans count as numeric (0/1)."""
    cols = columns or [f.name for f in df.schema.fields
                       if isinstance(f.dataType, NumericType) or f.dataType.simpleString() == "boolean"]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, mean double, std double, min double, max double, median double")
    x = {c: F.col(f"`{c}`").cast("int").cast("double") if df.schema[c].dataType.simpleString() == "boolean"
         else F.col(f"`{c}`").cast("double") for c in cols}
    src = df.select(*[x[c].alias(c) for c in cols])
    med = exact_quantiles(src, {c: [0.5] for c in cols})
    agg = src.agg(*[e for i, c in enumerate(cols) for e in (
        F.avg(F.col(f"`{c}`")).alias(f"_a{i}"), F.stddev_samp(F.col(f"`{c}`")).alias(f"_s{i}"),
        F.min(F.col(f"`{c}`")).alias(f"_lo{i}"), F.max(F.col(f"`{c}`")).alias(f"_hi{i}"))])
    items = [(F.lit(c), F.col(f"_a{i}"), F.col(f"_s{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"),
              F.lit(med[c][0]).cast("double")) for i, c in enumerate(cols)]
    return (agg.select(_stack(items, ["column", "mean", "std", "min", "max", "median"]).alias("s"))
            .select("s.column", *[rnd(F.col(f"s.{k}"), 2).alias(k)
                                  for k in ("mean", "std", "min", "max", "median")]))


def categorical_profile(df: DataFrame, columns: list[str] | None = None, top: int = 5,
                        distinct: str = "exact") -> DataFrame:
    """Per text column: distinct count (NULLs out) and the ``top`` most
    frequent values (count desc, then value), one row per (column, rank).

    ``distinct="approx"`` takes the distinct count from sketches
    (``sketches.relative_error``); the top values, always exact, then come from
    ``heavy.top_values``, which shuffles candidates only."""
    cols = columns or categorical_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, unique_count long, rank int, value string, n long")
    if distinct == "approx":
        uniq = sketches.distinct_counts(sketches.distinct_states(df, cols)).select("column", F.col("n_distinct").alias("unique_count"))
        return (heavy.top_values(df, cols, top).join(uniq, "column").select("column", "unique_count", "rank", "value", "n")
                .orderBy("column", "rank"))
    long = df.select(_stack([(F.lit(c), F.col(f"`{c}`").cast("string")) for c in cols],
                            ["column", "value"]).alias("s")).select("s.*").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return (ranked.join(uniq, "column").select("column", "unique_count", "rank", "value", "n")
            .orderBy("column", "rank"))


#: Columns of a block of the Gram matrix, rows multiplied at a time.
BLOCK, CHUNK = 64, 8192


def _gram(k: int):
    """Arrow batches of k columns -> (i, j, n, px, py, mx, my, cxy, cxx, cyy) of a task, for i <= j: over the rows where
    both columns have a value, their number, means less the pivots p, and sums of products and squares of deviations.

    With x 0 where it is missing and m the mask of values, products of matrices give plain sums; values are taken
    relative to the first one that the task sees in their column, so the sums don't cancel."""
    import numpy as np
    import pyarrow as pa

    names = ["i", "j", "n", "px", "py", "mx", "my", "cxy", "cxx", "cyy"]
    blocks = [(b, min(k, b + BLOCK)) for b in range(0, k, BLOCK)]

    def run(batches):
        n, sx, sxy, sxx = (np.zeros((k, k)) for _ in range(4))  # sx, sxx: of x_i and its square where j has a value
        pivot = np.full(k, np.nan)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1).astype(np.float64)
                mask = ~np.isnan(x)
                new = np.isnan(pivot) & mask.any(axis=0)
                pivot[new] = x[mask.argmax(axis=0)[new], new]
                x = np.where(mask, x - pivot, 0.0)
                m, sq = mask.astype(np.float64), x * x
                for p, q in blocks:
                    for r, t in blocks:
                        n[p:q, r:t] += m[:, p:q].T @ m[:, r:t]
                        sx[p:q, r:t] += x[:, p:q].T @ m[:, r:t]
                        sxx[p:q, r:t] += sq[:, p:q].T @ m[:, r:t]
                        if p <= r:
                            sxy[p:q, r:t] += x[:, p:q].T @ x[:, r:t]
        i, j = np.triu_indices(k)
        i, j = i[n[i, j] > 0], j[n[i, j] > 0]
        m, x, y, xx, yy = n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i]
        dxx, dyy = xx - x * x / m, yy - y * y / m
        values = [i, j, m, pivot[i], pivot[j], x / m, y / m, sxy[i, j] - x * y / m,
                  np.where(dxx > xx * 1e-13, dxx, 0.0), np.where(dyy > yy * 1e-13, dyy, 0.0)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=names)

    return run


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Pearson correlation of every pair of numeric columns on the rows where
    both are present, as long rows (x, y, r); r is NULL for a constant
    column. NaN counts as missing.

    Every task multiplies blocks of columns (a Gram matrix with the masks of
    missing values) and passes on one row of co-moments for each pair; these rows
    are the only shuffle. They are merged about the pair's common mean, which
    is stable however far from zero a column lies. The division is guarded, so a
    zero variance gives NULL instead of an error under ANSI mode."""
    cols = columns or numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "x string, y string, r double")
    src = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(cols)])
    parts = src.mapInArrow(_gram(len(cols)), "i bigint, j bigint, n double, px double, py double, mx double, "
                           "my double, cxy double, cxx double, cyy double")
    pair = Window.partitionBy("i", "j")
    for v in ("x", "y"):  # means, less a pivot common to all tasks; then their distance from the mean of all rows
        parts = parts.withColumn(f"m{v}", F.col(f"p{v}") - F.min(f"p{v}").over(pair) + F.col(f"m{v}"))
        parts = parts.withColumn(f"d{v}", F.col(f"m{v}") - F.sum(F.col("n") * F.col(f"m{v}")).over(pair) / F.sum("n").over(pair))

    def merged(moment: str, a: str, b: str):
        return F.sum(F.col(moment) + F.col("n") * F.col(a) * F.col(b))

    moments = parts.groupBy("i", "j").agg(F.try_divide(
        merged("cxy", "dx", "dy"), F.sqrt(merged("cxx", "dx", "dx")) * F.sqrt(merged("cyy", "dy", "dy"))).alias("r"))
    every = df.sparkSession.range(len(cols)).select(F.col("id").alias("i"), F.explode(F.sequence("id", F.lit(len(cols) - 1))).alias("j"))
    names = F.array(*[F.lit(c) for c in cols])
    fwd = F.struct(F.col("i").alias("p"), F.col("j").alias("q"))
    rev = F.struct(F.col("j").alias("p"), F.col("i").alias("q"))
    both = F.explode(F.when(F.col("i") == F.col("j"), F.array(fwd)).otherwise(F.array(fwd, rev)))
    bounded = F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r"))))
    return (every.join(moments, ["i", "j"], "left").select(both.alias("o"), bounded.alias("r"))
            .select(F.element_at(names, F.col("o.p").cast("int") + 1).alias("x"),
                    F.element_at(names, F.col("o.q").cast("int") + 1).alias("y"), rnd(F.col("r"), digits).alias("r")))
