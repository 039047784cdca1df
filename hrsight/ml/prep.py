"""Feature preparation for the attrition models.

The preparation is fitted on the training split only and lives inside the
``PipelineModel`` (fill values, category indexes, scaler), so scoring new
data replays exactly what training saw:

* numeric columns: NULL -> exact training median; text columns: NULL ->
  "Unknown" (a ``SQLTransformer`` whose statement carries the fitted
  values, so it is saved with the model);
* columns constant on the training split (min == max after filling) are
  dropped: one aggregate, no per-column distinct count;
* text columns: ``StringIndexer`` in alphabetical order; a value not seen
  in training gets code -1. A column with more than ``WIDE`` values gets the
  same codes from a table (distinct values in range-sorted order, numbered by
  partition offsets) that is joined, so its values never reach the driver;
* all features are standardised (mean 0, unit sample std).

The label is the "left" flag of ``hrsight.functions.exprs.label_flag``;
rows without a label value are not used for training. Id-like columns
(the id role, numbers, names) are never features.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from hrsight.functions.exprs import label_flag
from hrsight.functions.quantiles import exact_quantiles
from hrsight.roles import SEARCH_COLUMNS, Roles
from hrsight.session import scratch_path

LABEL = "label"
WEIGHT = "class_weight"
FEATURES = "features"
ROW_KEY = "_row_key"
UNKNOWN = "Unknown"
# Text columns with more distinct values are coded by a joined table.
WIDE = 10_000
# Medians of many columns share one budget of fetched rows: a finer sketch spares them the passes that narrow further.
SKETCH_ACCURACY = 5_000


@dataclass
class FeatureSpec:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    wide: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return self.numeric + self.categorical + self.wide


def labelled(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Add ``label`` (1.0 left / 0.0 stayed) and drop rows whose label value is NULL."""
    roles = Roles.of(roles)
    name = roles.label_col(df)
    if name is None:
        raise ValueError(f"no label column among {list(df.columns)}")
    return df.where(F.col(f"`{name}`").isNotNull()).withColumn(LABEL, label_flag(df, roles).cast("double"))


def row_key(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """A deterministic per-row hash key: of the id column when there is one,
    else of every column (identical rows share a key and a split side)."""
    roles = Roles.of(roles)
    idc = roles.id_col(df)
    cols = [F.col(f"`{idc}`")] if idc else [F.col(f"`{c}`") for c in df.columns]
    return df.withColumn(ROW_KEY, F.xxhash64(*cols))


def candidate_features(df: DataFrame, roles: Roles | None = None, exclude: tuple[str, ...] = (),
                       wide: int = WIDE) -> FeatureSpec:
    """Numeric and text feature columns. Text columns with more than ``wide``
    distinct values (estimated in one pass) are coded by a joined table."""
    roles = Roles.of(roles)
    skip = {LABEL, WEIGHT, ROW_KEY, FEATURES, roles.label_col(df), roles.id_col(df), *SEARCH_COLUMNS, *exclude}
    spec = FeatureSpec()
    for f in df.schema.fields:
        if f.name in skip or f.name.startswith("_"):
            continue
        if isinstance(f.dataType, (NumericType, BooleanType)):
            spec.numeric.append(f.name)
        elif isinstance(f.dataType, StringType):
            spec.categorical.append(f.name)
    if spec.categorical:
        est = df.agg(*[F.approx_count_distinct(F.col(_q(c))).alias(f"d{i}")
                       for i, c in enumerate(spec.categorical)]).collect()[0]
        spec.wide = [c for i, c in enumerate(spec.categorical) if est[f"d{i}"] > wide]
        spec.categorical = [c for c in spec.categorical if c not in spec.wide]
    return spec


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the column's distinct texts (NULL as "Unknown") numbered from 0 in alphabetical order."""
    spark = df.sparkSession
    path = scratch_path(spark, f"codes-{uuid.uuid4().hex}")
    (df.select(F.coalesce(F.col(_q(column)).cast("string"), F.lit(UNKNOWN)).alias("value")).distinct()
     .repartitionByRange("value").withColumn("part", F.spark_partition_id()).write.parquet(path))
    values = spark.read.parquet(path)
    sizes = values.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition
    first = sizes.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS first")
    within = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return values.withColumn("within", within).join(F.broadcast(first), "part").select(
        "value", (F.col("first") + F.col("within")).cast("double").alias("code"))


def with_codes(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Add ``_i_<column>`` for the columns coded by a table; a value that it lacks gets -1."""
    for c, table in codes.items():
        table = table.select(F.col("value").alias("_code_value"), F.col("code").alias(f"_i_{c}"))
        key = F.coalesce(F.col(_q(c)).cast("string"), F.lit(UNKNOWN))
        df = df.join(table, key == F.col("_code_value"), "left").drop("_code_value") \
            .withColumn(f"_i_{c}", F.coalesce(F.col(_q(f"_i_{c}")), F.lit(-1.0)))
    return df


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v))


def fit_preparation(train: DataFrame, spec: FeatureSpec) -> tuple[PipelineModel, FeatureSpec]:
    """Fit fill values, drop constant columns, index text, assemble, scale.
    ``train`` has the columns of ``with_codes`` for ``spec.wide``."""
    num = spec.numeric
    cat = spec.categorical
    src = train.select(*[F.col(_q(c)).cast("double").alias(c) for c in num],
                       *[F.col(_q(c)) for c in cat])
    med = exact_quantiles(src, {c: [0.5] for c in num}, sketch_accuracy=SKETCH_ACCURACY) if num else {}
    fills = {c: (med[c][0] if med[c][0] is not None else 0.0) for c in num}
    filled = [F.coalesce(F.col(_q(c)), F.lit(fills[c])).alias(c) for c in num] + \
             [F.coalesce(F.col(_q(c)), F.lit(UNKNOWN)).alias(c) for c in cat]
    if num or cat:
        mm = src.select(*filled).agg(*[e for i, c in enumerate(num + cat)
                                       for e in (F.min(_q(c)).alias(f"lo{i}"), F.max(_q(c)).alias(f"hi{i}"))]
                                     ).collect()[0]
    keep_num, keep_cat, dropped = [], [], []
    for i, c in enumerate(num + cat):
        if mm[f"lo{i}"] is None or mm[f"lo{i}"] == mm[f"hi{i}"]:
            dropped.append(c)
        elif c in num:
            keep_num.append(c)
        else:
            keep_cat.append(c)
    kept = FeatureSpec(keep_num, keep_cat, [*spec.dropped, *dropped], list(spec.wide))
    # Stage 1: fill (fitted values baked into the statement).
    fill_sql = ", ".join([f"coalesce(CAST({_q(c)} AS DOUBLE), {_lit(fills[c])}) AS {_q('_n_' + c)}" for c in keep_num]
                         + [f"coalesce(CAST({_q(c)} AS STRING), {_lit(UNKNOWN)}) AS {_q('_s_' + c)}"
                            for c in keep_cat])
    fill = SQLTransformer(statement=f"SELECT *{', ' + fill_sql if fill_sql else ''} FROM __THIS__")
    # One multi-column indexer: all text columns in one pass.
    indexers = [StringIndexer(inputCols=[f"_s_{c}" for c in keep_cat], outputCols=[f"_k_{c}" for c in keep_cat],
                              stringOrderType="alphabetAsc", handleInvalid="keep")] if keep_cat else []
    first = Pipeline(stages=[fill, *indexers]).fit(train)
    # Stage 2: unseen category (code == number of labels) -> -1.
    n_labels = ({c: len(labels) for c, labels in zip(keep_cat, first.stages[1].labelsArray)}
                if keep_cat else {})
    remap = ", ".join(f"CASE WHEN {_q('_k_' + c)} >= {n_labels[c]} THEN -1.0 ELSE {_q('_k_' + c)} END "
                      f"AS {_q('_i_' + c)}" for c in keep_cat)
    unseen = SQLTransformer(statement=f"SELECT *{', ' + remap if remap else ''} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"_n_{c}" for c in keep_num] + [f"_i_{c}" for c in keep_cat + spec.wide],
                                outputCol="_raw_features", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw_features", outputCol=FEATURES, withMean=True, withStd=True)
    staged = first.transform(train)
    second = Pipeline(stages=[unseen, assembler, scaler]).fit(staged)
    return PipelineModel(stages=[*first.stages, *second.stages]), kept


def add_missing_columns(df: DataFrame, spec: FeatureSpec, train_types: dict[str, str]) -> DataFrame:
    """Scoring data may lack a training column: add it as NULL (then filled
    with the training value)."""
    out = df
    for c in spec.names:
        if c not in df.columns:
            out = out.withColumn(c, F.lit(None).cast(train_types.get(c, "double")))
    return out


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced class weights n / (k * n_c), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.crossJoin(F.broadcast(tot)).select(
        label, "n_c", (F.col("n") / (F.col("k") * F.col("n_c"))).alias(WEIGHT))


def with_class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Attach the weight column; the weight table has one row per class, so
    it is broadcast (its size is the number of classes)."""
    w = class_weights(df, label).select(label, WEIGHT)
    return df.join(F.broadcast(w), label, "left")


def split(df: DataFrame, test_size: float = 0.2, seed: int = 42, folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Stratified train/test split, and a fold number in [0, folds) for the
    training rows, exact per class.

    Rows get a hash of their key. Of a class with n rows the round(test_size * n)
    with the smallest hashes are the test rows, and ranks of a second hash cut
    the others into folds of equal size: exact quantiles of the hashes give the
    thresholds, so there is no sort or window over a class, and recomputed
    partitions land on the same side. Identical rows of a frame without an id
    share a hash and stay together."""
    # 52 bits: a double holds them exactly
    tagged = (df.withColumn("_h", F.pmod(F.xxhash64(F.col(ROW_KEY), F.lit(seed)), F.lit(1 << 52)).cast("double"))
              .withColumn("_g", F.pmod(F.xxhash64(F.col(ROW_KEY), F.lit(seed + 1)), F.lit(1 << 52)).cast("double")))
    counts = {r[LABEL]: r["n"] for r in tagged.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(counts)

    def thresholds(frame: DataFrame, column: str, cuts: dict) -> dict:
        """{class: values between rank k - 1 and rank k, for its k in cuts}"""
        hashes = frame.select(*[F.when(F.col(LABEL) == c, F.col(column)).alias(f"h{i}") for i, c in enumerate(classes)])
        levels = {f"h{i}": [min(1.0, max(0.0, (k - 0.5) / max(1, sizes[c] - 1))) for k in cuts[c]] for i, c in enumerate(classes)}
        got = exact_quantiles(hashes, levels)
        return {c: [float("-inf") if k <= 0 else float("inf") if k >= sizes[c] else v for k, v in zip(cuts[c], got[f"h{i}"])]
                for i, c in enumerate(classes)}

    sizes = counts
    cut = thresholds(tagged, "_h", {c: [int(round(test_size * counts[c]))] for c in classes})
    is_test = reduce(lambda e, c: F.when(F.col(LABEL) == c, F.col("_h") < cut[c][0]).otherwise(e), classes, F.lit(False))
    tagged = tagged.withColumn("_is_test", is_test)
    train, test = tagged.where(~F.col("_is_test")), tagged.where("_is_test").drop("_h", "_g", "_is_test")
    sizes = {c: counts[c] - int(round(test_size * counts[c])) for c in classes}
    ends = thresholds(train, "_g", {c: [int(round(sizes[c] * j / folds)) for j in range(1, folds)] for c in classes})
    fold = reduce(lambda e, c: F.when(F.col(LABEL) == c, reduce(
        lambda n, v: n + (F.col("_g") >= v).cast("int"), ends[c], F.lit(0))).otherwise(e), classes, F.lit(0))
    return train.withColumn("fold", fold.cast("int")).drop("_h", "_g", "_is_test"), test
