"""Regressors, prediction and model inspection (R1-R11) on ``pyspark.ml``.

Fitting is MLlib's own distributed code: linear regression aggregates its
normal equations with ``treeAggregate``; trees build level-wise histograms
on executors.  What this module adds is determinism (explicit seeds, tree fits
that do not depend on row placement) and tables instead of printouts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer
from pyspark.ml.regression import (
    DecisionTreeRegressionModel,
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketml.operators.binning import QuantileBinner
from marketml.operators.features import assembler
from marketml.plans.ensembles import ESTIMATORS

FAMILIES = ("linear", "tree", "forest", "gbt")
DEFAULT_SEED = 42


def estimator(family: str, label: str, features_col: str = "features",
              seed: int = DEFAULT_SEED, **params):
    """A regressor with the reference's defaults and a mandatory seed.

    linear: ``regParam`` 0 (R1, R2); tree: ``maxDepth`` 5 (R3); forest: 20
    trees of depth 5 (R4); gbt: 20 iterations, depth 5, step 0.1 (R5, R6).
    """
    common = {"featuresCol": features_col, "labelCol": label, **params}
    if family == "linear":
        return LinearRegression(**common)
    if family == "tree":
        return DecisionTreeRegressor(seed=seed, **{"maxDepth": 5, **common})
    if family == "forest":
        return RandomForestRegressor(seed=seed, **common)
    if family == "gbt":
        return GBTRegressor(seed=seed, **common)
    raise ValueError(f"family must be one of {FAMILIES}")


def canonical(df: DataFrame, partitions: int = 8) -> DataFrame:
    """Fixed row placement for MLlib's own seeded tools, whose output depends on where rows sit:
    ``TrainValidationSplit``, ``randomSplit``, forests with its bootstrap.  A hash of the whole row places it, so no key
    gathers its rows in one task, and orders it within its partition; rows with
    equal hashes are equal rows.  ``partitions`` is a plain parameter: neither the data's
    size nor the session's settings change it.  The library's own tree fits need no placement (``binned`` pipelines)."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    placed = df.withColumn("__row", row).repartition(partitions, "__row")
    return placed.sortWithinPartitions("__row").drop("__row")


def pipeline(family: str, features: Sequence[str], label: str, impute: bool = False, binned: bool = False, **params) -> Pipeline:
    """Assembler + regressor as one estimator.  With ``impute``, missing (NULL or
    NaN) features become the mean over the rows that the pipeline is fitted on.  With ``binned``, a tree
    family is fitted on quantile levels of its features (``operators/binning.py``,
    ``plans/ensembles.py``), so the model does not depend on where rows lie."""
    inputs, stages = list(features), []
    if impute:
        filled = [f"__filled_{f}" for f in inputs]
        stages.append(Imputer(inputCols=inputs, outputCols=filled, strategy="mean"))
        inputs = filled
    if not binned or family == "linear":
        return Pipeline(stages=[*stages, assembler(inputs), estimator(family, label, **params)])
    levels = [f"__level_{f}" for f in features]
    stages.append(QuantileBinner(inputCols=inputs, outputCols=levels))
    return Pipeline(stages=[*stages, assembler(levels), ESTIMATORS[family](labelCol=label, **params)])


def fit(df: DataFrame, family: str, features: Sequence[str], label: str, **params) -> PipelineModel:
    return pipeline(family, features, label, **params).fit(df)


def regressor(model):
    """The fitted regressor inside a pipeline (or the model itself)."""
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def predict(model, df: DataFrame) -> DataFrame:
    """Append ``prediction``."""
    return model.transform(df)


def predict_each(fitted: Sequence, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``(point, *keep, prediction)`` of several fitted pipelines over one scan of
    ``df``: a prediction column for each, unpivoted without a shuffle."""
    out, names = df, []
    for i, m in enumerate(fitted):
        name = f"__prediction_{i}"
        if isinstance(m, PipelineModel):
            # Every pipeline writes the same helper columns; they make way for the next one's.
            old = set(out.columns)
            stages = [*m.stages[:-1], m.stages[-1].copy({m.stages[-1].predictionCol: name})]
            out = PipelineModel(stages).transform(out)
            out = out.drop(*[c for c in out.columns if c not in old and c != name])
        else:
            out = m.copy({m.predictionCol: name}).transform(out)
        names.append(name)
    each = F.array(*[F.struct(F.lit(i).alias("point"), F.col(n).alias("prediction")) for i, n in enumerate(names)])
    return out.select(*keep, F.explode(each).alias("__p")).select("__p.point", *keep, "__p.prediction")


def coefficients(spark: SparkSession, model, features: Sequence[str],
                 stddevs: Mapping[str, float] | None = None) -> DataFrame:
    """``(term, coefficient, abs_coefficient, std_coefficient)`` with an
    ``intercept`` row first (R10, F7).  ``std_coefficient`` is the
    coefficient times the feature's standard deviation, a scale-free rank."""
    lr = regressor(model)
    coefs = lr.coefficients.toArray().tolist()
    rows = [("intercept", float(lr.intercept), abs(float(lr.intercept)), None)]
    for f, c in zip(features, coefs):
        sd = None if stddevs is None else stddevs.get(f)
        rows.append((f, float(c), abs(float(c)), None if sd is None else float(c) * sd))
    return spark.createDataFrame(
        rows, "term string, coefficient double, abs_coefficient double, std_coefficient double")


def feature_stddevs(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Population standard deviation of each feature, one aggregation."""
    row = df.agg(*[F.stddev_pop(F.col(f)).alias(f) for f in features]).first()
    return row.asDict()


def importances(spark: SparkSession, model, features: Sequence[str],
                source_model: str = "") -> DataFrame:
    """``(feature, importance, rank, source_model)`` sorted by importance
    descending (R9, A3); importances are >= 0 and sum to 1."""
    imp = regressor(model).featureImportances.toArray().tolist()
    order = sorted(range(len(features)), key=lambda i: (-imp[i], features[i]))
    rows = [(features[i], float(imp[i]), r + 1, source_model) for r, i in enumerate(order)]
    return spark.createDataFrame(
        rows, "feature string, importance double, rank int, source_model string"
    ).orderBy("rank")


def tree_root(model) -> dict | None:
    """Root split of a fitted tree: feature index, threshold, and each
    child's prediction and row count (R3 at depth 1); None where no split lowers the error."""
    root = regressor(model)._java_obj.rootNode()
    if not root.numDescendants():
        return None
    split = root.split()
    left, right = root.leftChild(), root.rightChild()
    return {
        "feature_index": int(split.featureIndex()),
        "threshold": float(split.threshold()),
        "left_prediction": float(left.prediction()),
        "right_prediction": float(right.prediction()),
        "n_left": int(left.impurityStats().count()),
        "n_right": int(right.impurityStats().count()),
    }


def truncated(model: DecisionTreeRegressionModel, depth: int) -> DecisionTreeRegressionModel:
    """The tree that a fit with ``maxDepth=depth`` gives: trees grow level by level, so a deeper one
    holds it, and every inner node has its own prediction."""
    tree = SparkSession.active().sparkContext._jvm.org.apache.spark.ml.tree

    def cut(node, left: int):
        if not node.numDescendants():
            return node
        if not left:
            return tree.LeafNode(node.prediction(), node.impurity(), node.impurityStats())
        return tree.InternalNode(node.prediction(), node.impurity(), node.gain(), cut(node.leftChild(), left - 1), cut(node.rightChild(), left - 1), node.split(), node.impurityStats())

    java = model._java_obj
    jvm = SparkSession.active().sparkContext._jvm
    out = DecisionTreeRegressionModel(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(f"{java.uid()}_{depth}", cut(java.rootNode(), depth), java.numFeatures()))
    out._resetUid(f"{java.uid()}_{depth}")
    out._set(**{p.name: v for p, v in model.extractParamMap().items() if model.isSet(p)} | {"maxDepth": depth})
    return out


def param_values(model, names: Sequence[str]) -> dict:
    """Read tuned parameter values off a fitted model."""
    reg = regressor(model)
    out = {}
    for n in names:
        out[n] = reg.getOrDefault(n) if reg.hasParam(n) else None
    return out
