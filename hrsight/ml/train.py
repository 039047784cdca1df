"""Train and compare attrition classifiers.

One run: label and split the data, fit the preparation on the training
split, then fit each candidate on the whole training split (the model kept)
and on the rest of each of its folds (cross-validation by the hash-assigned
``fold`` column), score the test split once (the scored rows are kept for the
ROC points), and record the metrics. All fits of all candidates run in one pool of threads, long ones first: a tree ensemble is
many short jobs that leave most cores idle, so several fits share them. The
folds don't touch the models kept: without cross-validation (``cv_folds=0``)
models, metrics and best model are the same. A failing candidate is recorded
with its error and does not stop the others. The best model is the highest
weighted F1; the first candidate wins ties.

Candidates and their defaults follow the reference settings: logistic
regression (L2, C = 1 i.e. regParam = 1 / sum of weights, balanced
weights), decision tree (depth 10, balanced), random forest (100 trees,
depth 15, sqrt features, balanced) and gradient-boosted trees (100 rounds,
depth 6, step 0.1, unweighted; one Spark estimator stands in for the
three boosting libraries). ``LIGHT`` is a smaller setting for quick runs.
"""

from __future__ import annotations

import logging
import time
import traceback
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from statistics import fmean, pstdev

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrsight.functions.exprs import col
from hrsight.ml import evaluate
from hrsight.ml.prep import (FEATURES, LABEL, ROW_KEY, WEIGHT, WIDE, FeatureSpec, candidate_features, category_codes,
                             fit_preparation, labelled, row_key, split, with_class_weights, with_codes)
from hrsight.roles import Roles

# Candidate settings (reference defaults) and a light preset.
# Logistic regression stops at the reference solver's default tolerance (1e-4).
DEFAULT = {
    "Logistic Regression": {"maxIter": 1000, "tol": 1e-4},
    "Decision Tree": {"maxDepth": 10},
    "Random Forest": {"numTrees": 100, "maxDepth": 15},
    "Gradient Boosting": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1},
}
LIGHT = {
    "Logistic Regression": {"maxIter": 100, "tol": 1e-4},
    "Decision Tree": {"maxDepth": 10},
    "Random Forest": {"numTrees": 20, "maxDepth": 8},
    "Gradient Boosting": {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1},
}

ROWS_PER_TASK = 20_000

RESULT_SCHEMA = ("model string, accuracy double, precision double, recall double, f1_score double, "
                 "roc_auc double, cv_mean double, cv_std double, confusion_matrix array<array<bigint>>, "
                 "error string")


def make_estimator(name: str, n_train: int, settings: dict, seed: int = 42):
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if name == "Logistic Regression":
        return LogisticRegression(**common, weightCol=WEIGHT, regParam=1.0 / max(n_train, 1),
                                  elasticNetParam=0.0, standardization=False, **settings)
    if name == "Decision Tree":
        return DecisionTreeClassifier(**common, weightCol=WEIGHT, impurity="gini", seed=seed, **settings)
    if name == "Random Forest":
        # with each row's node kept, a level of the 100 deep trees costs no walk from their roots
        return RandomForestClassifier(**common, weightCol=WEIGHT, featureSubsetStrategy="sqrt", seed=seed,
                                      maxMemoryInMB=1024, cacheNodeIds=True, **settings)
    if name == "Gradient Boosting":
        return GBTClassifier(**common, seed=seed, **settings)
    raise ValueError(f"unknown model {name!r}")


@dataclass
class TrainResult:
    prep: PipelineModel
    spec: FeatureSpec
    models: dict[str, object]
    results: DataFrame
    best: str | None
    test: DataFrame
    train_types: dict[str, str] = field(default_factory=dict)
    label_values: tuple[str, str] = ("No", "Yes")
    codes: dict[str, DataFrame] = field(default_factory=dict)
    scored: dict[str, DataFrame] = field(default_factory=dict)

    def release(self) -> None:
        """Give back the cached test rows."""
        self.test.unpersist()
        for rows in self.scored.values():
            rows.unpersist()

    def pipeline(self, name: str | None = None) -> PipelineModel:
        name = name or self.best
        return PipelineModel(stages=[*self.prep.stages, self.models[name]])


def _label_values(df: DataFrame, roles: Roles) -> tuple[str, str]:
    """The label's own texts for stayed and left: the most frequent of each side (the smaller of equals)."""
    name = roles.label_col(df)
    if df.schema[name].dataType.simpleString() != "string":
        return "0", "1"
    counts = df.groupBy(F.col(LABEL).alias("y"), col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    best = {r["y"]: r["b"]["v"] for r in counts.groupBy("y").agg(
        F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")).collect()}
    return best.get(0.0, "No"), best.get(1.0, "Yes")


def train_models(df: DataFrame, roles: Roles | None = None, settings: dict | None = None,
                 test_size: float = 0.2, seed: int = 42, cv_folds: int = 5, parallelism: int = 8,
                 exclude: tuple[str, ...] = (), wide: int = WIDE) -> TrainResult:
    roles = Roles.of(roles)
    settings = settings or DEFAULT
    spark: SparkSession = df.sparkSession
    # The input is read by ~10 passes (quantiles, ranges, indexing, scaling,
    # split counts, fits): persist it once instead of recomputing its plan.
    data = row_key(labelled(df, roles), roles).persist(StorageLevel.MEMORY_AND_DISK)
    spec = candidate_features(data, roles, exclude, wide)
    train, test = split(data, test_size, seed, max(cv_folds, 2))
    codes = {c: category_codes(train, c) for c in spec.wide}
    train, test = with_codes(train, codes), with_codes(test, codes)
    prep, kept = fit_preparation(train, spec)
    keep_cols = [FEATURES, LABEL, ROW_KEY]
    # Tree and gradient rounds are many short jobs over these rows: no more tasks than they are worth.
    # A few fits at a time get more tasks each, so that all cores have work.
    long_fits = 2 * (1 + max(cv_folds or 0, 0))
    tasks = max(1, -(-data.count() // ROWS_PER_TASK), spark.sparkContext.defaultParallelism // long_fits)
    train_p = (with_class_weights(prep.transform(train).select(*keep_cols, "fold")).coalesce(tasks)
               .persist(StorageLevel.MEMORY_AND_DISK))
    test_p = prep.transform(test).select(*keep_cols).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    n_train = train_p.count()
    f1_eval = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="weightedFMeasure")
    log = logging.getLogger("hrsight.train")

    def tested(model):
        """The test rows with label, prediction and probability, their confusion counts and AUC."""
        scored = (evaluate.with_probability(model.transform(test_p)).select(LABEL, "prediction", evaluate.PROB)
                  .persist(StorageLevel.MEMORY_AND_DISK))
        cm = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(scored).collect()}
        pos = cm.get((1, 0), 0) + cm.get((1, 1), 0)
        return scored, cm, evaluate.auc(scored, counts=(pos, sum(cm.values())))

    def fitted(job: tuple[str, int | None]):
        """The model kept (fold None) and how it tests, or the F1 of one fold; an exception is the result, not raised."""
        name, fold = job
        started = time.perf_counter()
        try:
            est = make_estimator(name, n_train, settings[name], seed)
            if fold is None:
                model = est.fit(train_p)
                return model, *tested(model)
            return f1_eval.evaluate(est.fit(train_p.where(F.col("fold") != fold)).transform(train_p.where(F.col("fold") == fold)))
        except Exception as e:  # noqa: BLE001 - a failing candidate is recorded, not fatal
            return e
        finally:
            log.info("%s, fold %s: %.1fs", name, fold, time.perf_counter() - started)

    folds = range(cv_folds) if cv_folds and cv_folds > 1 else ()
    # the later candidates take longest
    jobs = [(name, fold) for name in reversed(list(settings)) for fold in (None, *folds)]
    with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
        made = dict(zip(jobs, pool.map(inheritable_thread_target(spark)(fitted), jobs, chunksize=1)))
    rows, models, kept_rows = [], {}, {}
    best, best_f1 = None, None
    for name in settings:
        try:
            for job in jobs:
                if job[0] == name and isinstance(made[job], Exception):
                    raise made[job]
            model, scored, cm, a = made[name, None]
            cv = [made[name, k] for k in folds]
            m = evaluate.metrics_from_confusion(spark.createDataFrame(
                [(*k, n) for k, n in cm.items()], "actual int, predicted int, n long")).collect()[0]
            rows.append((name, round(m["accuracy"], 4), round(m["precision"], 4), round(m["recall"], 4),
                         round(m["f1_score"], 4), None if a is None else round(a, 4),
                         round(fmean(cv), 4) if cv else None, round(pstdev(cv), 4) if cv else None,
                         [[cm.get((0, 0), 0), cm.get((0, 1), 0)], [cm.get((1, 0), 0), cm.get((1, 1), 0)]],
                         None))
            models[name], kept_rows[name] = model, scored
            if best_f1 is None or m["f1_score"] > best_f1:
                best, best_f1 = name, m["f1_score"]
        except Exception as e:  # noqa: BLE001 - a failing candidate is recorded, not fatal
            if not isinstance(made[name, None], Exception):
                made[name, None][1].unpersist()
            rows.append((name, None, None, None, None, None, None, None, None,
                         f"{type(e).__name__}: {e}\n{traceback.format_exc()}"))
    values = _label_values(data, roles)
    train_p.unpersist()
    data.unpersist()
    results = spark.createDataFrame(rows, RESULT_SCHEMA)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return TrainResult(prep, kept, models, results, best, test_p, types, values, codes, kept_rows)


def feature_importance(result: TrainResult, name: str | None = None, top: int | None = None) -> DataFrame:
    """(feature, importance), descending: tree importances, or |coefficient|
    for logistic regression. Built from the fitted model's k numbers."""
    name = name or result.best
    model = result.models[name]
    names = result.spec.names
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        vals = [abs(v) for v in model.coefficients.toArray().tolist()]
    else:
        vals = []
    spark = result.results.sparkSession
    rows = sorted(zip(names, [float(v) for v in vals]), key=lambda t: (-t[1], t[0]))
    if top:
        rows = rows[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def model_comparison(result: TrainResult) -> DataFrame:
    """Long series (model, metric, label, value) of accuracy, precision,
    recall and F1 for the models that trained."""
    metrics = ["accuracy", "precision", "recall", "f1_score"]
    ok = result.results.where(F.col("error").isNull())
    long = ok.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                  for m in metrics])).alias("s"))
    return long.select("model", "s.metric",
                       F.initcap(F.regexp_replace("s.metric", "_", " ")).alias("label"), "s.value")


def roc_curves(result: TrainResult) -> DataFrame:
    """ROC points of every trained model, one for each distinct score, plus the chance diagonal."""
    spark = result.results.sparkSession
    out = spark.createDataFrame([("Random", 1.0, 0.0, 0.0), ("Random", 0.0, 1.0, 1.0)],
                                "model string, threshold double, fpr double, tpr double")
    for name, scored in result.scored.items():
        pts = evaluate.roc_points(scored).select(F.lit(name).alias("model"), "*")
        out = out.unionByName(pts)
    return out
