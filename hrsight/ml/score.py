"""Batch scoring with the trained pipeline (M14, M15, A23, K6) and model
persistence (S10, S11).

Scoring is ``PipelineModel.transform``: a narrow projection per row, so it
parallelises with the input partitions and needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hrsight.ml.prep import LABEL, FeatureSpec, add_missing_columns, with_codes
from hrsight.ml.train import TrainResult
from hrsight.operators.lookup import with_employee_id
from hrsight.operators.rowindex import with_index
from hrsight.roles import Roles

# Risk bands on the unrounded probability.
HIGH_RISK, MEDIUM_RISK = 0.7, 0.4
RISK_LEVELS = ("Low Risk", "Medium Risk", "High Risk")


def predict(df: DataFrame, pipeline: PipelineModel, spec: FeatureSpec, roles: Roles | None = None,
            train_types: dict[str, str] | None = None, label_values: tuple[str, str] = ("No", "Yes"),
            codes: dict[str, DataFrame] | None = None, index: bool = True) -> DataFrame:
    """Per row: employee_id, index, prediction, predicted_label, probability of
    leaving (4 dp), risk level, risk score (percent, 1 dp) and confidence
    max(p, 1 - p) (4 dp). Bands compare the unrounded probability. ``index`` is
    the frame's column of that name, else the dense number of
    ``rowindex.with_index``; ``index=False`` spares its shuffle where the frame
    has ids and nobody reads the number."""
    roles = Roles.of(roles)
    src = df if "index" in df.columns or not index else with_index(df)
    src = with_employee_id(add_missing_columns(src, spec, train_types or {}), roles)
    if LABEL in src.columns:
        src = src.drop(LABEL)
    src = with_codes(src, codes or {})
    scored = pipeline.transform(src)
    return risk_columns(scored, vector_to_array(F.col("probability")).getItem(1), label_values,
                        ["employee_id", *(["index"] if "index" in src.columns else [])])


def risk_columns(scored: DataFrame, p: Column, label_values: tuple[str, str] = ("No", "Yes"),
                 keys: Sequence[str] = ("employee_id",)) -> DataFrame:
    """The key columns and everything that follows from ``prediction`` and the probability ``p``."""
    pred = F.col("prediction").cast("int")
    return scored.select(
        *keys, pred.alias("prediction"),
        F.when(pred == 1, F.lit(label_values[1])).otherwise(F.lit(label_values[0])).alias("predicted_label"),
        F.bround(p, 4).alias("attrition_probability"),
        F.when(p >= HIGH_RISK, RISK_LEVELS[2]).when(p >= MEDIUM_RISK, RISK_LEVELS[1])
         .otherwise(RISK_LEVELS[0]).alias("risk_level"),
        F.bround(p * 100.0, 1).alias("risk_score"),
        F.bround(F.greatest(p, F.lit(1.0) - p), 4).alias("confidence"),
        p.alias("probability"))


def predict_with(result: TrainResult, df: DataFrame, roles: Roles | None = None, name: str | None = None,
                 index: bool = True) -> DataFrame:
    return predict(df, result.pipeline(name), result.spec, roles, result.train_types, result.label_values,
                   result.codes, index)


def risk_distribution(predictions: DataFrame) -> DataFrame:
    """Counts per risk level over all predictions, zeros kept."""
    return predictions.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.sum(F.when(F.col("risk_level") == lvl, 1).otherwise(0)).cast("long").alias(
            lvl.lower().replace(" ", "_") + "_count") for lvl in RISK_LEVELS])


def top_risk(predictions: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` rows with the highest unrounded probability (ties by id): a top-k read."""
    return predictions.orderBy(F.desc("probability"), F.asc("employee_id")).limit(n).drop("probability")


def save_model(result: TrainResult, path: str, name: str | None = None) -> None:
    """Best (or named) pipeline, feature spec and all model results."""
    name = name or result.best
    result.pipeline(name).write().overwrite().save(f"{path}/pipeline")
    result.results.write.mode("overwrite").parquet(f"{path}/results")
    for i, c in enumerate(result.spec.wide):
        result.codes[c].write.mode("overwrite").parquet(f"{path}/codes/{i}")
    meta = {"model": name, "numeric": result.spec.numeric, "categorical": result.spec.categorical,
            "dropped": result.spec.dropped, "wide": result.spec.wide, "train_types": result.train_types,
            "label_values": list(result.label_values)}
    spark = result.results.sparkSession
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> dict:
    meta = json.loads(spark.read.json(f"{path}/meta").collect()[0]["meta"])
    return {"pipeline": PipelineModel.load(f"{path}/pipeline"),
            "spec": FeatureSpec(meta["numeric"], meta["categorical"], meta["dropped"], meta["wide"]),
            "codes": {c: spark.read.parquet(f"{path}/codes/{i}") for i, c in enumerate(meta["wide"])},
            "model": meta["model"], "train_types": meta["train_types"],
            "label_values": tuple(meta["label_values"]),
            "results": spark.read.parquet(f"{path}/results")}
