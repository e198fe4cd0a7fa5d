"""Hyper-parameter tuning.

* Cross-validation uses ``CrossValidator`` with ``foldCol`` set from a key
  hash, so folds are the same on any partitioning (and in SQL).
* A linear grid needs no fit a candidate: one scan gives the folds' moments, and these all
  candidates' fits and scores (``linear_cross_validate``).  A tree's depths need one fit, of the deepest, which
  holds the others (``nested_cross_validate``, ``nested_train_validate``).
* Train-validation tuning has two forms: the reference's
  ``TrainValidationSplit`` (random split, seeded) and a deterministic one
  that fits every grid point on a hash-flagged train part and scores it on
  the validation part.
* Candidate fits run ``parallelism`` at a time from driver threads; each fit
  is itself a distributed job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import chain
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketml.operators.evaluate import metrics_dict, regression_metrics
from marketml.operators.moments import merged, moments, score, solve
from marketml.plans.models import predict_each, truncated


def grid(stage, params: Mapping[str, Sequence]) -> list:
    """Cartesian parameter grid over a pipeline stage."""
    b = ParamGridBuilder()
    for name, values in params.items():
        b = b.addGrid(stage.getParam(name), list(values))
    return b.build()


def grid_rows(param_maps: Sequence) -> list[dict]:
    """Each param map as ``{param name: value}``."""
    return [{p.name: v for p, v in pm.items()} for pm in param_maps]


def rmse_evaluator(label: str) -> RegressionEvaluator:
    return RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")


def cross_validate(est, param_maps, df: DataFrame, label: str, fold_col: str, num_folds: int,
                   parallelism: int = 2, collect_sub_models: bool = False):
    """k-fold CV on a fold column, select by RMSE, refit the best point on
    all of ``df`` (T2, T4, T5).  Returns the ``CrossValidatorModel``."""
    cv = CrossValidator(
        estimator=est, estimatorParamMaps=list(param_maps), evaluator=rmse_evaluator(label),
        numFolds=num_folds, foldCol=fold_col, parallelism=parallelism,
        collectSubModels=collect_sub_models,
    )
    return cv.fit(df)


def best_index(metrics: Sequence[float]) -> int:
    """Lowest metric, first on ties."""
    return min(range(len(metrics)), key=lambda i: (metrics[i], i))


def candidate_table(spark, cv_model, param_maps) -> DataFrame:
    """Per-candidate mean and spread of the fold RMSE (T6), which the
    reference computed but never read: ``(point, params, avg_rmse,
    std_rmse, is_best)``."""
    rows = grid_rows(param_maps)
    best = best_index(cv_model.avgMetrics)
    std = list(getattr(cv_model, "stdMetrics", None) or [None] * len(rows))
    data = [
        (i, ", ".join(f"{k}={v}" for k, v in sorted(r.items())), float(cv_model.avgMetrics[i]),
         None if std[i] is None else float(std[i]), i == best)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "point int, params string, avg_rmse double, std_rmse double, is_best boolean")


def fold_metrics(cv_model, df: DataFrame, fold_col: str, label: str) -> DataFrame:
    """RMSE of every (grid point, fold) sub-model on its held-out fold (T6),
    with one scan a fold and one aggregation: ``(point, fold, n, rmse)``.
    Needs ``collect_sub_models=True``."""
    parts = None
    for f, fitted in enumerate(cv_model.subModels):
        held = df.where(F.col(fold_col) == f)
        p = predict_each(fitted, held, [label]).withColumn("fold", F.lit(f))
        parts = p if parts is None else parts.unionByName(p)
    out = regression_metrics(parts, label, group_cols=["point", "fold"])
    return out.select("point", "fold", "n", "rmse")


@dataclass
class FoldCV:
    """Cross-validation of a grid: scores of every (point, fold) and the best point refitted on all rows."""

    folds: list[dict]  # point, fold, n, rmse, r2
    avgMetrics: list[float]
    stdMetrics: list[float]
    bestModel: object

    def transform(self, df: DataFrame) -> DataFrame:
        return self.bestModel.transform(df)


def linear_cross_validate(est, param_maps, df: DataFrame, features: Sequence[str], label: str, fold_col: str) -> FoldCV:
    """k-fold CV of ``regParam`` and ``elasticNetParam`` from one scan: the folds' moments fit and score every
    (point, fold); only the best point is fitted by MLlib (T2, T4, T5, T6)."""
    rows = [{"regParam": 0.0, "elasticNetParam": 0.0, **r} for r in grid_rows(param_maps)]
    by_fold = moments(df, [*features, label], fold_col)
    folds = []
    for i, r in enumerate(rows):
        for f in sorted(by_fold):
            line = solve(merged([m for g, m in by_fold.items() if g != f]), r["regParam"], r["elasticNetParam"])
            folds.append({"point": i, "fold": f, **score(by_fold[f], *line)})
    each = [[s["rmse"] for s in folds if s["point"] == i] for i in range(len(rows))]
    avg = [float(np.mean(e)) for e in each]
    return FoldCV(folds, avg, [float(np.std(e)) for e in each], est.fit(df, param_maps[best_index(avg)]))


def point_fits(est, param_maps, df: DataFrame):
    """A function that fits a param map on ``df``.  The stages of a pipeline before its last, if no map changes
    them, are fitted once for all maps."""
    stages = est.getStages() if isinstance(est, Pipeline) else []
    if len(stages) < 2 or {p.parent for m in param_maps for p in m} - {stages[-1].uid}:
        return lambda m: est.fit(df, m)
    before = Pipeline(stages=stages[:-1]).fit(df)
    ready = before.transform(df)
    return lambda m: PipelineModel([*before.stages, stages[-1].fit(ready, m)])


def fold_cross_validate(est, param_maps, df: DataFrame, label: str, fold_col: str, num_folds: int, parallelism: int = 8) -> FoldCV:
    """k-fold CV whose (point, fold) fits all run side by side, where ``CrossValidator`` takes one fold after the
    other; the best point is fitted again on all rows (T2, T4, T5, T6)."""

    def one(at: tuple[int, int]) -> dict:
        i, f = at
        fitted = fits[f](param_maps[i])
        return {"point": i, "fold": f, **metrics_dict(fitted.transform(df.where(F.col(fold_col) == f)), label)}

    with ThreadPool(max(1, parallelism)) as pool:
        fits = pool.map(lambda f: point_fits(est, param_maps, df.where(F.col(fold_col) != f)), range(num_folds), chunksize=1)
        folds = pool.map(one, [(i, f) for i in range(len(param_maps)) for f in range(num_folds)], chunksize=1)
    each = [[s["rmse"] for s in folds if s["point"] == i] for i in range(len(param_maps))]
    avg = [float(np.mean(e)) for e in each]
    return FoldCV(folds, avg, [float(np.std(e)) for e in each], est.fit(df, param_maps[best_index(avg)]))


def _depth_candidates(pipe: Pipeline, param_maps, df: DataFrame) -> list[PipelineModel]:
    """A fitted tree for each depth of the grid, cut from one fit of the deepest."""
    depths = [r["maxDepth"] for r in grid_rows(param_maps)]
    deepest = pipe.fit(df, param_maps[depths.index(max(depths))])
    return [PipelineModel([*deepest.stages[:-1], truncated(deepest.stages[-1], d)]) for d in depths]


def nested_cross_validate(pipe: Pipeline, param_maps, df: DataFrame, label: str, fold_col: str, num_folds: int, parallelism: int = 2) -> FoldCV:
    """k-fold CV of a tree's ``maxDepth`` with one fit a fold, of the deepest, and one scan of the fold for
    all candidates; only the best point is fitted again (T2, T4, T5, T6)."""

    def fold(f: int) -> list[dict]:
        fitted = _depth_candidates(pipe, param_maps, df.where(F.col(fold_col) != f))
        scored = regression_metrics(predict_each(fitted, df.where(F.col(fold_col) == f), [label]), label, group_cols=["point"])
        return [{"fold": f, **r.asDict()} for r in scored.collect()]

    with ThreadPool(max(1, parallelism)) as pool:
        folds = sorted(chain.from_iterable(pool.map(fold, range(num_folds))), key=lambda s: (s["point"], s["fold"]))
    each = [[s["rmse"] for s in folds if s["point"] == i] for i in range(len(param_maps))]
    avg = [float(np.mean(e)) for e in each]
    return FoldCV(folds, avg, [float(np.std(e)) for e in each], pipe.fit(df, param_maps[best_index(avg)]))


@dataclass
class TrainValidationResult:
    best_index: int
    metrics: list[dict]
    model: object


def nested_train_validate(pipe: Pipeline, param_maps, df: DataFrame, label: str, valid_col: str) -> TrainValidationResult:
    """Train-validation tuning of a tree's ``maxDepth`` with one fit, of the deepest, and one scan of the validation rows."""
    fitted = _depth_candidates(pipe, param_maps, df.where(~F.col(valid_col)))
    scored = regression_metrics(predict_each(fitted, df.where(F.col(valid_col)), [label]), label, group_cols=["point"])
    metrics = sorted((r.asDict() for r in scored.collect()), key=lambda r: r["point"])
    best = best_index([m["rmse"] for m in metrics])
    return TrainValidationResult(best, metrics, pipe.fit(df, param_maps[best]))


def train_validate(est, param_maps, df: DataFrame, label: str, valid_col: str,
                   parallelism: int = 2, refit: bool = True) -> TrainValidationResult:
    """Deterministic train-validation tuning (T3): fit each grid point on
    rows where ``valid_col`` is false, score RMSE on the others, then refit
    the best point on all of ``df``."""
    param_maps = list(param_maps)
    train = df.where(~F.col(valid_col))
    valid = df.where(F.col(valid_col))
    fit = point_fits(est, param_maps, train)

    with ThreadPool(max(1, parallelism)) as pool:
        metrics = pool.map(lambda m: metrics_dict(fit(m).transform(valid), label), param_maps, chunksize=1)
    best = best_index([m["rmse"] for m in metrics])
    model = est.fit(df, param_maps[best]) if refit else None
    return TrainValidationResult(best, metrics, model)


def train_validation_split(est, param_maps, df: DataFrame, label: str, train_ratio: float = 0.8,
                           seed: int = 42, parallelism: int = 1):
    """The reference's random ``TrainValidationSplit`` (seeded)."""
    tvs = TrainValidationSplit(
        estimator=est, estimatorParamMaps=list(param_maps), evaluator=rmse_evaluator(label),
        trainRatio=train_ratio, seed=seed, parallelism=parallelism,
    )
    return tvs.fit(df)
