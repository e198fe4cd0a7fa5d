"""Linear fits, folds and ablations from mergeable moments."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from marketml.operators import moments as mo
from marketml.operators.evaluate import metrics_dict
from marketml.plans import models, tuning, workflows
from marketml.registry import ALL, LABEL
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def frame(spark):
    return workflows.model_frame(workflows.market_table(spark, SF_SMALL)).cache()


def _of(x):
    return mo.Moments(len(x), x.mean(0), np.cov(x.T, bias=True))


def test_moments_merge_like_one_table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 3, (300, 3))
    parts = [_of(x[:7]), _of(x[7:150]), mo.Moments(0, np.zeros(3), np.zeros((3, 3))), _of(x[150:])]
    whole = mo.merged(parts)
    assert whole.n == 300 and np.allclose(whole.mean, x.mean(0), rtol=1e-14) and np.allclose(whole.cov, np.cov(x.T, bias=True), rtol=1e-8)
    df = spark.createDataFrame([(i % 3, *map(float, r)) for i, r in enumerate(x)], "g int, a double, b double, y double")
    got = mo.moments(df.repartition(5), ["a", "b", "y"], "g")
    assert sorted(got) == [0, 1, 2]
    for g, m in got.items():
        assert m.n == 100 and np.allclose(m.cov, _of(x[g::3]).cov, rtol=1e-7)
    assert mo.moments(df, ["a", "y"])[None].of([1]).cov.shape == (1, 1)
    with pytest.raises(ValueError, match="NULLs in .'b'."):
        mo.moments(df.withColumn("b", F.when(F.col("g") > 0, F.col("b"))), ["a", "b", "y"])
    assert mo.moments(df.limit(0), ["a", "y"], "g") == {}
    assert mo.moments(df.limit(0), ["a", "y"])[None].n == 0


@pytest.mark.parametrize("reg", [0.0, 0.01, 0.1, 2000.0])
@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_solution_is_optimal_and_mllibs(spark, frame, reg, alpha):
    m = mo.moments(frame, [*ALL, LABEL])[None]
    coef, intercept = mo.solve(m, reg, alpha)
    assert mo.optimality_gap(m, coef, reg, alpha) < 1e-12
    fitted = models.fit(frame, "linear", ALL, LABEL, regParam=reg, elasticNetParam=alpha, tol=1e-12, maxIter=1000)
    theirs = models.regressor(fitted)
    assert mo.optimality_gap(m, theirs.coefficients.toArray(), reg, alpha) < 1e-4
    ours, want = mo.score(m, coef, intercept), metrics_dict(fitted.transform(frame), LABEL)
    assert ours["n"] == want["n"] and abs(ours["rmse"] / want["rmse"] - 1) < 1e-4
    assert mo.optimality_gap(m, coef * 1.01, reg, alpha) > 1e-4


def test_odd_columns():
    x = np.array([[1.0, 5.0, 2.0], [2.0, 5.0, 4.0], [3.0, 5.0, 6.0]])
    coef, intercept = mo.solve(_of(x))
    assert np.allclose(coef, [2, 0]) and abs(intercept) < 1e-12
    coef, intercept = mo.solve(_of(x), 0.1, 1.0)
    assert coef[1] == 0 and 0 < coef[0] < 2
    assert mo.solve(_of(x[:, [0, 1]]))[1] == 5.0
    twice = np.c_[x[:, 0], x[:, 0], x[:, 2]]  # equal features share the coefficient
    assert np.allclose(mo.solve(_of(twice))[0], [1, 1])


def test_linear_cross_validation_equals_crossvalidator(spark, frame):
    train = frame.where("split = 'train'").cache()
    pipe = models.pipeline("linear", ALL, LABEL)
    maps = tuning.grid(pipe.getStages()[-1], {"regParam": [0.01, 2000.0], "elasticNetParam": [0.0, 1.0]})
    theirs = tuning.cross_validate(pipe, maps, train, LABEL, "fold", 3)
    ours = tuning.linear_cross_validate(pipe, maps, train, ALL, LABEL, "fold")
    assert np.allclose(ours.avgMetrics, theirs.avgMetrics, rtol=1e-4) and np.allclose(ours.stdMetrics, theirs.stdMetrics, rtol=1e-2)
    assert len(ours.folds) == 12 and sum(f["n"] for f in ours.folds) == 4 * train.count()
    best = maps[tuning.best_index(ours.avgMetrics)]
    assert models.param_values(ours.bestModel, ["regParam", "elasticNetParam"]) == {p.name: v for p, v in best.items()}
    table = tuning.candidate_table(spark, ours, maps).collect()
    assert [r.is_best for r in table].count(True) == 1


def test_one_scan_and_one_fit(spark, frame, tmp_path, monkeypatch):
    frame.write.parquet(str(tmp_path / "frame"))
    df = spark.read.parquet(str(tmp_path / "frame"))
    pipe = models.pipeline("linear", ALL, LABEL)
    maps = tuning.grid(pipe.getStages()[-1], {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]})
    scans, fits = [], []
    take = type(df.groupBy()).agg
    monkeypatch.setattr(type(df.groupBy()), "agg", lambda self, *c: scans.append(1) or take(self, *c))
    fit = Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    tuning.linear_cross_validate(pipe, maps, df, ALL, LABEL, "fold")
    assert (len(scans), len(fits)) == (1, 1)
    monkeypatch.undo()
    plan = df.groupBy("fold").agg(F.covar_pop(ALL[0], LABEL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_covar" in plan


def test_ablations_equal_refits(spark, frame):
    got = {r.feature_set: r for r in workflows.linear_ablations(spark, frame, ALL, LABEL).collect()}
    want = workflows.ablation_report(spark, frame, "linear", ALL, LABEL, ALL).collect()
    assert len(got) == len(want) == len(ALL) + 1
    for w in want:
        g = got[w.feature_set]
        assert (g.n, g.n_features) == (w.n, w.n_features)
        assert np.allclose([g.rmse, g.r2, g.rmse_change_pct], [w.rmse, w.r2, w.rmse_change_pct], rtol=1e-6, atol=1e-6)
    with pytest.raises(ValueError, match="training and test"):
        workflows.linear_ablations(spark, frame.where("split = 'test'"), ALL, LABEL)
