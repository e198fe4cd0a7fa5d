"""Quantile levels and tree families that do not depend on where rows lie."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marketml.operators import binning
from marketml.plans import ensembles, models, tuning, workflows
from marketml.registry import ALL, LABEL
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def frame(spark):
    return workflows.model_frame(workflows.market_table(spark, SF_SMALL)).cache()


def test_binner_levels(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([0.0, 0.0, 0.0, rng.uniform(-5, 5)]), None, rng.gauss(0, 1)) for i in range(500)]
    rows += [(900, float("nan"), None, None), (901, None, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, tied double, empty double, smooth double")
    names = ["tied", "empty", "smooth"]
    fitted = binning.QuantileBinner(inputCols=names, outputCols=[f"l_{n}" for n in names], levels=8).fit(df.repartition(5))
    out = {r.id: r for r in fitted.transform(df).collect()}
    for k, name in ((1, "tied"), (3, "smooth")):
        values = sorted(r[k] for r in rows if r[k] is not None and not math.isnan(r[k]))
        edges = sorted({float(np.quantile(values, q / 8)) for q in range(1, 8)})
        assert np.allclose(fitted.getSplitsArray()[names.index(name)][1:-1], edges)
        edges = fitted.getSplitsArray()[names.index(name)][1:-1]
        for r in rows:
            level = None if r[k] is None else len(edges) + 1 if math.isnan(r[k]) else sum(e <= r[k] for e in edges)
            assert out[r[0]][f"l_{name}"] == level
    assert {r.l_empty for r in out.values()} == {None}


def test_grid_sums_are_exact():
    rng = np.random.default_rng(0)
    for rows in (10, 1000, 100_000):
        y = rng.uniform(-3e5, 3e5, rows)
        unit = ensembles.grid_unit(3e5, rows)
        k = np.floor(y / unit + 0.5) * unit
        for values in (k, k * k):
            assert len({float(np.sum(rng.permutation(values))) for _ in range(5)} | {float(sum(values.tolist()))}) == 1
    assert ensembles.grid_unit(0.0, 5) == 1.0


def test_bag_weights(spark):
    steps = ensembles.poisson_steps()
    assert abs(steps[0] - math.exp(-1)) < 1e-15 and steps == sorted(steps) and steps[-1] < 1
    df = spark.range(20_000)
    got = df.select(*[ensembles.bag_weight(F.col("id"), t, 7).alias(f"w{t}") for t in range(2)]).toPandas()
    assert abs(got.w0.mean() - 1) < 0.03 and abs(got.w0.var() - 1) < 0.05
    assert abs(got.w0.corr(got.w1)) < 0.03
    import hashlib
    for i in (0, 5, 77):
        draw = int(hashlib.md5(f"7:1:{i}".encode()).hexdigest()[:8], 16) / 2**32
        assert got.w1[i] == sum(draw >= s for s in steps)
    used = [ensembles.tree_features(6, t, 0.5, 1) for t in range(40)]
    assert all(len(u) == 3 for u in used) and len({tuple(u) for u in used}) > 5


@pytest.mark.parametrize(("family", "params"), [("tree", {}), ("forest", {"numTrees": 3}), ("gbt", {"maxIter": 12, "maxDepth": 3})])
def test_same_model_on_any_layout(spark, frame, family, params):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    seen = []
    for parts in (2, 8, 64):
        placed = train.repartition(parts, F.rand(parts)).sortWithinPartitions(F.rand(parts + 1)).cache()
        model = models.fit(placed, family, ALL, LABEL, binned=True, **params)
        seen.append((models.regressor(model).featureImportances.toArray().tolist(),
                     [r.prediction for r in model.transform(test).orderBy("row_key").select("prediction").collect()]))
        placed.unpersist()
    assert seen[0] == seen[1] == seen[2]
    assert models.param_values(model, ["maxDepth", *params]) == {"maxDepth": 5, **params}


def test_splits_are_thresholds_on_levels(spark, frame):
    model = models.fit(frame, "tree", ALL, LABEL, binned=True)
    text = models.regressor(model).toDebugString
    assert " <= " in text and " in {" not in text


def test_cells_fit_what_rows_fit(spark):
    """Rows of equal levels as one weighted cell give MLlib's tree on the rows."""
    from pyspark.ml.regression import DecisionTreeRegressor
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(8 * a + 3 * b * (a > 2)) + float(rng.integers(0, 4))) for a, b in rng.integers(0, 5, (600, 2))]
    df = spark.createDataFrame(rows, "a int, b int, y double").withColumn("features", array_to_vector(F.array(F.col("a").cast("double"), F.col("b").cast("double"))))
    ours = ensembles.CellTree(labelCol="y", maxDepth=4).fit(df)
    plain = DecisionTreeRegressor(labelCol="y", maxDepth=4).fit(df)
    got = [(r.prediction, s.prediction) for r, s in zip(ours.transform(df).collect(), plain.transform(df).collect(), strict=True)]
    assert all(abs(a - b) < 1e-4 for a, b in got)
    with pytest.raises(ValueError, match="no rows"):
        ensembles.CellTree(labelCol="y").fit(df.limit(0))


def test_a_tree_outlives_no_collected_model(spark, frame, monkeypatch):
    import gc
    import time

    fit = ensembles.RandomForestRegressor.fit

    class Java:
        def __init__(self, java):
            self.java = java

        def trees(self):
            gc.collect()
            time.sleep(1)  # a collected object's Java side goes a little later
            return self.java.trees()

    class Model:
        def __init__(self, model):
            self.model, self._java_obj = model, Java(model._java_obj)

    monkeypatch.setattr(ensembles.RandomForestRegressor, "fit", lambda self, rows: Model(fit(self, rows)))
    model = models.fit(frame, "gbt", ALL, LABEL, binned=True, maxIter=2, maxDepth=2)
    assert models.regressor(model).getNumTrees == 2


def test_forest_without_a_key_column(spark, frame):
    train = frame.where("split = 'train'").drop("row_key")
    a, b = (models.fit(train.repartition(n), "forest", ALL, LABEL, binned=True, numTrees=2, maxDepth=3) for n in (1, 6))
    assert models.regressor(a).featureImportances == models.regressor(b).featureImportances


def test_truncated_trees_are_the_shallower_fits(spark, frame):
    train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
    deepest = models.fit(train, "tree", ALL, LABEL, binned=True, maxDepth=6)
    score = lambda stage: [r.prediction for r in stage.transform(deepest.stages[1].transform(deepest.stages[0].transform(test))).orderBy("row_key").collect()]
    for depth in (0, 1, 3, 6):
        cut = models.truncated(models.regressor(deepest), depth)
        assert cut.depth == min(depth, models.regressor(deepest).depth) and models.param_values(cut, ["maxDepth"]) == {"maxDepth": depth}
        if depth:
            assert score(cut) == score(models.regressor(models.fit(train, "tree", ALL, LABEL, binned=True, maxDepth=depth)))


def test_nested_depths_need_one_fit_a_fold(spark, frame, monkeypatch):
    from pyspark.ml import Pipeline

    train = frame.where("split = 'train'").cache()
    pipe = models.pipeline("tree", ALL, LABEL, binned=True)
    maps = tuning.grid(pipe.getStages()[-1], {"maxDepth": [2, 5, 3]})
    plain = tuning.cross_validate(pipe, maps, train, LABEL, "fold", 3)
    fits, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    nested = tuning.nested_cross_validate(pipe, maps, train, LABEL, "fold", 3)
    assert len(fits) == 4 and np.allclose(nested.avgMetrics, plain.avgMetrics, rtol=1e-12)
    assert [(f["point"], f["fold"]) for f in nested.folds] == [(p, f) for p in range(3) for f in range(3)]
    fits.clear()
    res = tuning.nested_train_validate(pipe, maps, train, LABEL, "is_validation")
    assert len(fits) == 2
    want = tuning.train_validate(pipe, maps, train, LABEL, "is_validation")
    assert np.allclose([m["rmse"] for m in res.metrics], [m["rmse"] for m in want.metrics], rtol=1e-12) and res.best_index == want.best_index


def test_folds_side_by_side_equal_crossvalidator(spark, frame):
    train = frame.where("split = 'train'").cache()
    pipe = models.pipeline("gbt", ALL, LABEL, binned=True, maxIter=2)
    maps = tuning.grid(pipe.getStages()[-1], {"maxDepth": [2, 3]})
    plain = tuning.cross_validate(pipe, maps, train, LABEL, "fold", 3, parallelism=2)
    ours = tuning.fold_cross_validate(pipe, maps, train, LABEL, "fold", 3)
    assert ours.avgMetrics == pytest.approx(list(plain.avgMetrics), rel=1e-12)
    assert models.param_values(ours.bestModel, ["maxDepth"]) == models.param_values(plain.bestModel, ["maxDepth"])
