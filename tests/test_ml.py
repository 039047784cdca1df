from dataclasses import replace
from statistics import median

import pytest
from pyspark.sql import functions as F

from conftest import hr_frame, to_spark
from hrsight.ml import compiled, evaluate, score, train
from hrsight.ml.prep import (FeatureSpec, candidate_features, category_codes, fit_preparation, labelled, row_key,
                             split)
from hrsight.roles import Roles
from hrsight.session import scratch_path
from hrsight.sources.synthetic import synthetic_employees

SMALL = {"Logistic Regression": {"maxIter": 20}, "Decision Tree": {"maxDepth": 4}}


@pytest.fixture(scope="module")
def result(spark):
    df = synthetic_employees(spark, 600, keep_id=False).withColumn(
        "EmployeeID", F.concat(F.lit("S"), F.monotonically_increasing_id().cast("string"))).cache()
    return df, train.train_models(df, settings=SMALL, cv_folds=2, parallelism=2)


def test_results_and_best(result):
    _, res = result
    rows = {r["model"]: r for r in res.results.collect()}
    assert set(rows) == set(SMALL)
    for r in rows.values():
        assert r["error"] is None
        assert 0 <= r["accuracy"] <= 1 and 0 <= r["roc_auc"] <= 1
        assert r["cv_mean"] is not None and r["cv_std"] >= 0
        cm = r["confusion_matrix"]
        assert sum(map(sum, cm)) == res.test.count()
        assert r["accuracy"] == pytest.approx((cm[0][0] + cm[1][1]) / sum(map(sum, cm)), abs=1e-4)
    best = max(rows.values(), key=lambda r: r["f1_score"])["f1_score"]
    assert rows[res.best]["f1_score"] == best


def test_auc_exact_against_brute_force(result):
    _, res = result
    scored = evaluate.with_probability(res.models[res.best].transform(res.test))
    pts = [(r["p_left"], r["label"]) for r in scored.select("p_left", "label").collect()]
    pos = [p for p, y in pts if y == 1]
    neg = [p for p, y in pts if y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert evaluate.auc(scored) == pytest.approx(brute, abs=1e-12)
    roc = evaluate.roc_points(scored).collect()
    assert roc[0]["fpr"] == 0.0 and roc[-1]["fpr"] == pytest.approx(1.0) and roc[-1]["tpr"] == pytest.approx(1.0)


def test_weighted_metrics_zero_division(spark):
    cm = spark.createDataFrame([(0, 0, 5), (1, 0, 5)], "actual int, predicted int, n long")
    r = evaluate.metrics_from_confusion(cm).collect()[0]
    assert r["accuracy"] == 0.5
    assert r["precision"] == pytest.approx(0.5 * 0.5)  # class 1 never predicted -> precision 0
    assert r["f1_score"] == pytest.approx(0.5 * (2 * 0.5 * 1.0 / 1.5))


def test_scoring_bands_and_distribution(result):
    df, res = result
    pred = score.predict_with(res, df)
    rows = pred.collect()
    assert len(rows) == df.count()
    for r in rows[:200]:
        p = r["attrition_probability"]
        assert r["confidence"] == pytest.approx(max(p, 1 - p), abs=1e-4)
        assert r["predicted_label"] in ("Yes", "No")
    dist = score.risk_distribution(pred).collect()[0]
    assert dist["low_risk_count"] + dist["medium_risk_count"] + dist["high_risk_count"] == dist["total"]
    assert len(score.top_risk(pred, 10).collect()) == 10


def test_risk_band_edges(spark):
    import pyspark.sql.functions as Fn
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import StructField, StructType, DoubleType
    schema = StructType([StructField("probability", VectorUDT()), StructField("prediction", DoubleType())])
    probs = [0.3999, 0.4, 0.69996, 0.7]
    df = spark.createDataFrame([(Vectors.dense([1 - p, p]), 0.0) for p in probs], schema)
    from pyspark.ml.functions import vector_to_array
    q = vector_to_array("probability")[1]
    levels = df.select(Fn.when(q >= score.HIGH_RISK, "High Risk").when(q >= score.MEDIUM_RISK, "Medium Risk")
                       .otherwise("Low Risk").alias("l"), Fn.bround(q, 4).alias("r")).collect()
    assert [r["l"] for r in levels] == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk"]
    assert levels[2]["r"] == 0.7  # rounds to 0.7 but is banded before rounding


def test_save_and_load_give_same_predictions(spark, result):
    df, res = result
    path = scratch_path(spark, "test-model-save")
    score.save_model(res, path)
    loaded = score.load_model(spark, path)
    a = score.predict_with(res, df).orderBy("employee_id").collect()
    b = score.predict(df, loaded["pipeline"], loaded["spec"], train_types=loaded["train_types"],
                      label_values=loaded["label_values"], codes=loaded["codes"]).orderBy("employee_id").collect()
    assert a == b
    assert loaded["results"].count() == len(SMALL)


def test_unseen_category_and_missing_column(spark):
    tr = spark.createDataFrame([("a", 1.0, "Yes"), ("b", 2.0, "No"), ("a", None, "No"), ("b", 4.0, "Yes")],
                               "cat string, x double, Attrition string")
    data = labelled(tr, Roles.of())
    spec = candidate_features(data, Roles.of())
    assert spec == FeatureSpec(["x"], ["cat"])
    model, kept = fit_preparation(data, spec)
    new = spark.createDataFrame([("zzz", None)], "cat string, x double")
    out = model.transform(new).select("_i_cat", "_n_x").collect()[0]
    assert out["_i_cat"] == -1.0 and out["_n_x"] == 2.0  # training median of {1, 2, 4}


def test_constant_columns_dropped(spark):
    tr = spark.createDataFrame([(1.0, 3.0, "k", "Yes"), (2.0, 3.0, "k", "No")],
                               "x double, c double, s string, Attrition string")
    data = labelled(tr, Roles.of())
    _, kept = fit_preparation(data, candidate_features(data, Roles.of()))
    assert kept.numeric == ["x"] and set(kept.dropped) == {"c", "s"}


def test_feature_importance_and_comparison(result):
    _, res = result
    imp = train.feature_importance(res, top=5).collect()
    assert len(imp) == 5 and imp[0]["importance"] >= imp[-1]["importance"]
    comp = train.model_comparison(res).collect()
    assert len(comp) == 4 * len(SMALL) and {r["label"] for r in comp} >= {"F1 Score", "Accuracy"}


def wide_rows(spark, n=12_000):
    rows = [(f"E{i}", f"n{i}" if i % 50 else None, "a" if i % 2 else "b", float(i % 97), "left" if i % 3 else "stayed") for i in range(n)]
    return spark.createDataFrame(rows, "EmployeeID string, code string, grp string, x double, Attrition string").cache()


def test_text_of_very_many_values_stays_a_feature(spark):
    df = wide_rows(spark)
    spec = candidate_features(labelled(df, Roles.of()), Roles.of())
    assert spec.wide == ["code"] and spec.categorical == ["grp"] and not spec.dropped
    codes = {r.value: r.code for r in category_codes(df, "code").collect()}
    assert [codes[v] for v in sorted(codes)] == [float(i) for i in range(len(codes))] and "Unknown" in codes
    res = train.train_models(df, settings={"Decision Tree": {"maxDepth": 3}}, cv_folds=2)
    assert {r["feature"] for r in train.feature_importance(res).collect()} == {"x", "grp", "code"}
    pred = score.predict_with(res, df.withColumn("index", F.lit(7)))
    assert {r.predicted_label for r in pred.collect()} <= {"left", "stayed"} and pred.first()["index"] == 7
    path = scratch_path(spark, "wide-model")
    score.save_model(res, path)
    back = score.load_model(spark, path)
    again = score.predict(df, back["pipeline"], back["spec"], None, back["train_types"], back["label_values"], back["codes"])
    assert sorted(map(str, again.collect())) == sorted(map(str, score.predict_with(res, df).collect()))


def test_split_is_exact_per_class(spark):
    data = row_key(labelled(wide_rows(spark, 1003), Roles.of()), Roles.of())
    tr, te = split(data, 0.2, folds=5)
    got = {}
    for r in tr.groupBy("label", "fold").count().collect():
        got.setdefault(r["label"], {})[r["fold"]] = r["count"]
    test = {r["label"]: r["count"] for r in te.groupBy("label").count().collect()}
    for y, n in {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}.items():
        assert test[y] == round(0.2 * n)
        assert sorted(got[y]) == [0, 1, 2, 3, 4] and max(got[y].values()) - min(got[y].values()) <= 1
        assert sum(got[y].values()) == n - test[y]
    assert tr.join(te, "EmployeeID").count() == 0


def test_roc_has_every_distinct_score(spark):
    rows = [((i * 37 % 101) / 101.0, float(i * 7 % 3 == 0)) for i in range(400)]
    got = evaluate.roc_points(spark.createDataFrame(rows, "p_left double, label double").repartition(5)).collect()
    pos = sum(y for _, y in rows)
    want = [(float("inf"), 0.0, 0.0)] + [
        (t, sum(1 - y for p, y in rows if p >= t) / (len(rows) - pos), sum(y for p, y in rows if p >= t) / pos)
        for t in sorted({p for p, _ in rows}, reverse=True)]
    assert [tuple(r) for r in got] == [pytest.approx(w) for w in want]


def test_top_risk_orders_by_the_unrounded_probability(spark):
    rows = [("a", 91.2, 0.91161), ("b", 91.2, 0.91244), ("c", 90.0, 0.9)]
    got = score.top_risk(spark.createDataFrame(rows, "employee_id string, risk_score double, probability double"), 1).collect()
    assert got[0].employee_id == "b"


def test_folds_do_not_change_the_models(spark):
    """Same models, metrics and best model with and without cross-validation; only its figures are added."""
    df = to_spark(spark, hr_frame(400, seed=21))
    settings = {"Logistic Regression": {"maxIter": 50}, "Decision Tree": {"maxDepth": 4},
                "Gradient Boosting": {"maxIter": 4, "maxDepth": 3}}
    one = train.train_models(df, settings=settings, cv_folds=0)
    two = train.train_models(df, settings=settings, cv_folds=3)
    assert one.best == two.best
    for a, b in zip(one.results.orderBy("model").collect(), two.results.orderBy("model").collect()):
        assert [a[c] for c in ("model", "accuracy", "f1_score", "roc_auc", "confusion_matrix", "error")] == [
            b[c] for c in ("model", "accuracy", "f1_score", "roc_auc", "confusion_matrix", "error")]
        assert a.cv_mean is None and 0 <= b.cv_mean <= 1 and b.cv_std >= 0
    assert one.models["Decision Tree"].toDebugString.split("\n")[1:] == two.models["Decision Tree"].toDebugString.split("\n")[1:]


def test_failing_candidate_is_recorded(spark):
    df = to_spark(spark, hr_frame(200, seed=4))
    got = train.train_models(df, settings={"Decision Tree": {"maxDepth": 3}, "Random Forest": {"maxDepth": -1}}, cv_folds=2)
    errors = {r.model: r.error for r in got.results.collect()}
    assert errors["Decision Tree"] is None and errors["Random Forest"] and got.best == "Decision Tree"


@pytest.fixture(scope="module")
def four_models(spark):
    df = to_spark(spark, hr_frame(500, seed=33)).withColumn("JobRole", F.when(F.col("JobRole") == "Analyst", "O'Neil \\ \"x\"").otherwise(F.col("JobRole")))
    settings = {"Logistic Regression": {"maxIter": 30}, "Decision Tree": {"maxDepth": 5},
                "Random Forest": {"numTrees": 5, "maxDepth": 4}, "Gradient Boosting": {"maxIter": 5, "maxDepth": 3}}
    return df, train.train_models(df, settings=settings, cv_folds=0)


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting"])
def test_compiled_model_equals_transform(spark, four_models, name):
    """SQL text in Spark and in DuckDB against the pipeline, unseen texts, NULLs and missing columns included."""
    import duckdb

    df, res = four_models
    new = df.withColumn("JobRole", F.when(F.col("EmployeeID") > "E0400", "never seen").otherwise(F.col("JobRole"))) \
        .withColumn("Age", F.when(F.col("EmployeeID") > "E0300", F.col("Age"))).drop("EnvironmentSatisfaction")
    card = compiled.Scorecard.from_json(compiled.compile_model(res, name).to_json())
    want = {r.employee_id: r.probability for r in score.predict_with(res, new, name=name).collect()}
    got = {r.EmployeeID: r.probability for r in compiled.score(new, card, ["EmployeeID"]).collect()}
    assert got.keys() == want.keys() and len(set(want.values())) > 3
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    pdf = new.withColumn("EnvironmentSatisfaction", F.lit(None).cast("int")).toPandas()
    con = duckdb.connect()
    con.register("rows", pdf)
    other = {r[0]: r[1] for r in con.execute(card.sql("rows", ["EmployeeID"], "duckdb")).fetchall()}
    assert other.keys() == want.keys() and max(abs(other[k] - want[k]) for k in want) < 1e-9


def test_forest_with_kept_nodes_grows_the_same_trees(spark):
    from pyspark.ml.linalg import Vectors
    rows = [(Vectors.dense([i * 37 % 101, i * 11 % 17, i * i % 29]), float(i * i % 7 < 2), 1.0 + (i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, ["features", "label", "class_weight"]).coalesce(2).cache()
    est = train.make_estimator("Random Forest", 600, {"numTrees": 4, "maxDepth": 12})
    assert est.getCacheNodeIds()
    kept, walked = est.fit(df), est.copy({est.cacheNodeIds: False}).fit(df)
    assert max(t.depth for t in kept.trees) > 10
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]


def test_test_rows_are_scored_once_for_metrics_and_roc(spark, four_models):
    _, res = four_models
    assert res.scored.keys() == res.models.keys()
    assert all(s.storageLevel.useMemory for s in res.scored.values())
    got = train.roc_curves(replace(res, models={}, test=None))  # needs neither models nor test rows again
    name = "Random Forest"
    want = evaluate.roc_points(evaluate.with_probability(res.models[name].transform(res.test)))
    assert sorted(map(tuple, got.where(F.col("model") == name).drop("model").collect())) == sorted(map(tuple, want.collect()))
    assert {r.model for r in got.select("model").distinct().collect()} == {"Random", *res.models}


def test_medians_of_many_columns_are_exact_without_narrowing(spark, monkeypatch):
    """24 order statistics of 900,000 rows fit the shared budget of 100,000 fetched rows; the medians stay exact."""
    from hrsight.ml import prep
    rows = [((i * 7919 % 10007) / 7.0, float(i % 13), float(i % 2), "Yes" if i % 3 else "No") for i in range(4000)]
    df = labelled(spark.createDataFrame(rows, "x double, y double, z double, Attrition string"), Roles.of())
    seen, found = {}, {}

    def spy(frame, wanted, **kw):
        seen.update(kw)
        found.update(prep_quantiles(frame, wanted, **kw))
        return found

    prep_quantiles = prep.exact_quantiles
    monkeypatch.setattr(prep, "exact_quantiles", spy)
    fit_preparation(df, candidate_features(df, Roles.of()))
    assert 8 * 900_000 / seen.get("sketch_accuracy", 1_000) <= 100_000 / 24
    assert found == {c: [median(r[i] for r in rows)] for i, c in enumerate("xyz")}
