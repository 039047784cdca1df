"""A fitted model as plain SQL: fill, codes, scaling and the classifier as expressions.

``compile_model`` reads the fitted stages of a training run into a ``Scorecard``
(numbers, labels and tree nodes; it can be stored as JSON). ``Scorecard.sql``
writes it as one SELECT, for Spark or for another SQL engine, and ``score`` runs
that text on a frame: scoring needs neither the ML library nor a model object,
stays one narrow projection, and equals ``PipelineModel.transform``.

Trees are nested CASE expressions over the scaled features, so the text grows
with the number of nodes: meant for models of up to some thousand nodes; for
larger ensembles ``transform`` is the way. Columns coded by a joined table
(``FeatureSpec.wide``) must be there as ``_i_<column>`` (``prep.with_codes``).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from hrsight.ml.prep import UNKNOWN
from hrsight.ml.train import TrainResult


@dataclass
class Feature:
    """One input: a number with its fill value, a text with its labels in code order, or a code column."""
    column: str
    kind: str
    fill: float | None
    labels: list[str]
    mean: float
    scale: float


@dataclass
class Scorecard:
    """``kind``: 'logistic' (weights, intercept) or 'trees': each tree is a leaf value or [feature, threshold, left, right],
    weighted and summed; ``link`` 'logit' maps the sum s to 1 / (1 + exp(-2 s)), 'mean' divides it by the number of trees."""
    features: list[Feature]
    kind: str
    weights: list[float]
    intercept: float
    trees: list
    link: str

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Scorecard":
        d = json.loads(text)
        return Scorecard(**{**d, "features": [Feature(**f) for f in d["features"]]})

    def sql(self, source: str, keys: list[str], dialect: str = "spark", name: str = "probability") -> str:
        """SELECT of the key columns and the probability of leaving; ``dialect`` 'spark' or 'duckdb' decides quoting only."""
        spark = dialect == "spark"

        def ident(n: str) -> str:
            return "`" + n.replace("`", "``") + "`" if spark else '"' + n.replace('"', '""') + '"'

        def text(v: str) -> str:
            return "'" + (v.replace("\\", "\\\\").replace("'", "\\'") if spark else v.replace("'", "''")) + "'"

        def raw(f: Feature) -> str:
            if f.kind == "number":
                return f"coalesce(CAST({ident(f.column)} AS DOUBLE), {_number(f.fill)})"
            if f.kind == "code":
                return ident(f"_i_{f.column}")
            cases = " ".join(f"WHEN {text(v)} THEN {_number(i)}" for i, v in enumerate(f.labels))
            return f"CASE coalesce(CAST({ident(f.column)} AS {'STRING' if spark else 'VARCHAR'}), {text(UNKNOWN)}) {cases} ELSE {_number(-1)} END"

        inputs = [f"({raw(f)} - {_number(f.mean)}) * {_number(f.scale)} AS f{i}" for i, f in enumerate(self.features)]
        if self.kind == "logistic":
            s = " + ".join([f"f{i} * {_number(w)}" for i, w in enumerate(self.weights)] + [_number(self.intercept)])
            p = f"1 / (1 + exp(-({s})))"
        else:
            s = " + ".join(f"{_number(w)} * {_case(t)}" for w, t in zip(self.weights, self.trees))
            p = f"({s}) / {_number(len(self.trees))}" if self.link == "mean" else f"1 / (1 + exp(-2 * ({s})))"
        cols = ", ".join(ident(k) for k in keys)
        return f"SELECT {cols}, {p} AS {name} FROM (SELECT {', '.join([cols, *inputs])} FROM {source}) AS scaled"


def _number(v: float) -> str:
    """A literal that is a double in every dialect and reads back as the same double."""
    return f"{float(v):.17e}" if v >= 0 else f"(-{-float(v):.17e})"


def _case(tree) -> str:
    if not isinstance(tree, list):
        return _number(tree)
    feature, threshold, left, right = tree
    return f"CASE WHEN f{feature} <= {_number(threshold)} THEN {_case(left)} ELSE {_case(right)} END"


def _nodes(node, leaf):
    """The tree under a JVM node; ``leaf`` reads a leaf's value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return leaf(node)
    split = node.split()
    return [split.featureIndex(), split.threshold(), _nodes(node.leftChild(), leaf), _nodes(node.rightChild(), leaf)]


def _share(node) -> float:
    """The weighted share of label 1 among a leaf's training rows."""
    stats = list(node.impurityStats().stats())
    return stats[1] / sum(stats)


def compile_model(result: TrainResult, name: str | None = None) -> Scorecard:
    """The Scorecard of one model of a training run (the best one by default)."""
    model = result.models[name or result.best]
    spec = result.spec
    stages = result.prep.stages
    spark = result.results.sparkSession
    # the fill values are what the fitted first stage makes of NULLs
    empty = spark.createDataFrame([(None,) * (len(spec.numeric) + len(spec.categorical))], ", ".join(
        f"`{c.replace('`', '``')}` {'double' if c in spec.numeric else 'string'}" for c in [*spec.numeric, *spec.categorical])) \
        if spec.numeric or spec.categorical else None
    fills = stages[0].transform(empty).first() if empty is not None else None
    labels = {}
    if spec.categorical:
        labels = dict(zip(spec.categorical, stages[1].labelsArray))
    scaler = stages[-1]
    features = []
    for i, c in enumerate(spec.names):
        sd = float(scaler.std[i])
        shape = ("number", fills[f"_n_{c}"], []) if c in spec.numeric else \
            ("text", None, list(labels[c])) if c in spec.categorical else ("code", None, [])
        features.append(Feature(c, *shape, float(scaler.mean[i]), 0.0 if sd == 0 else 1.0 / sd))
    if hasattr(model, "coefficients"):
        return Scorecard(features, "logistic", [float(w) for w in model.coefficients], float(model.intercept), [], "logit")
    if hasattr(model, "treeWeights") and type(model).__name__ == "GBTClassificationModel":
        trees = [_nodes(t.rootNode(), lambda n: n.prediction()) for t in model._java_obj.trees()]
        return Scorecard(features, "trees", [float(w) for w in model.treeWeights], 0.0, trees, "logit")
    roots = model._java_obj.trees() if hasattr(model, "trees") else [model._java_obj]
    trees = [_nodes(t.rootNode(), _share) for t in roots]
    return Scorecard(features, "trees", [1.0] * len(trees), 0.0, trees, "mean")


def score(df: DataFrame, card: Scorecard, keys: list[str], name: str = "probability") -> DataFrame:
    """The key columns and the probability of leaving; columns that the frame lacks count as NULL."""
    from pyspark.sql import functions as F

    for f in card.features:
        if f.kind != "code" and f.column not in df.columns:
            df = df.withColumn(f.column, F.lit(None).cast("double" if f.kind == "number" else "string"))
    return df.sparkSession.sql(card.sql("{scored_rows}", keys, "spark", name), scored_rows=df)
