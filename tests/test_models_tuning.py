import pytest
from pyspark.sql import functions as F

from marketml.operators.evaluate import metrics_dict, regression_metrics
from marketml.plans import models, report, tuning, workflows
from marketml.sources.market import FEATURES, KEYS, LABEL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frame(spark):
    return workflows.model_frame(workflows.market_table(spark, SF))


@pytest.fixture(scope="module")
def train(frame):
    return frame.where(F.col("split") == "train")


@pytest.fixture(scope="module")
def test_rows(frame):
    return frame.where(F.col("split") == "test")


def test_sf001_full_sample_linear_fit(spark, frame):
    # Known values of the whole-table fit at sf0.01.
    m = models.regressor(models.fit(frame, "linear", ["median_list_price"], LABEL))
    assert m.coefficients[0] == pytest.approx(0.93747329, abs=1e-8)
    assert m.intercept == pytest.approx(646.56827, abs=1e-4)


def test_linear_matches_regr_slope(spark, train):
    m = models.regressor(models.fit(train, "linear", ["median_list_price"], LABEL))
    s = train.agg(F.regr_slope(LABEL, "median_list_price"), F.regr_intercept(LABEL, "median_list_price")).first()
    assert m.coefficients[0] == pytest.approx(s[0], rel=1e-10)
    assert m.intercept == pytest.approx(s[1], rel=1e-9)


def test_metrics_equal_evaluator(spark, train, test_rows):
    from pyspark.ml.evaluation import RegressionEvaluator

    pred = models.fit(train, "linear", ["median_list_price"], LABEL).transform(test_rows)
    mine = metrics_dict(pred, LABEL)
    for name in ("rmse", "r2", "mae"):
        ev = RegressionEvaluator(labelCol=LABEL, metricName=name).evaluate(pred)
        assert mine[name] == pytest.approx(ev, rel=1e-10)


@pytest.mark.parametrize("family", ["tree", "forest", "gbt"])
def test_importance_invariants(spark, train, family):
    tr = models.canonical(train)
    model = models.fit(tr, family, FEATURES, LABEL, maxIter=5) if family == "gbt" else \
        models.fit(tr, family, FEATURES, LABEL)
    imp = models.importances(spark, model, FEATURES, family).collect()
    vals = [r.importance for r in imp]
    assert all(v >= 0 for v in vals) and sum(vals) == pytest.approx(1.0)
    assert vals == sorted(vals, reverse=True)
    assert imp[0].feature == "median_list_price"


def test_forest_is_reproducible_across_layouts(spark, train):
    a = models.canonical(train)
    b = models.canonical(train.repartition(3).sortWithinPartitions(F.desc("period_begin")))
    ia = models.regressor(models.fit(a, "forest", FEATURES, LABEL)).featureImportances.toArray()
    ib = models.regressor(models.fit(b, "forest", FEATURES, LABEL)).featureImportances.toArray()
    assert list(ia) == list(ib)


def test_forest_does_not_depend_on_session_partitions(spark, train):
    """The placement's partition count is a parameter: the session's shuffle
    setting changes neither it nor the fitted forest."""
    got, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            placed = models.canonical(train)
            assert placed.rdd.getNumPartitions() == 8
            got.append(list(models.regressor(models.fit(placed, "forest", FEATURES, LABEL)).featureImportances.toArray()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_a_hot_key_spreads_over_partitions(spark):
    hot = spark.range(4000).select(F.lit(1).alias("region"), F.col("id").alias("x"))
    sizes = [r["count"] for r in models.canonical(hot).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / len(sizes)


@pytest.mark.parametrize("family", ["tree", "gbt"])
@pytest.mark.parametrize("keys", [["region", "period"], None])
def test_workflow_takes_any_key_names(spark, tmp_path, family, keys):
    rename = {"region_id": "region", "period_begin": "period"}
    if family == "tree":
        rename |= {LABEL: "median_sale_price13"}
        extra = {"PERIOD_BEGIN59": F.col("period_begin")}
    else:
        extra = {n: F.col("homes_sold") % k for k, n in enumerate(
            ["pending_sales", "months_of_supply", "median_list_ppsf", "price_drops", "sold_above_list", "median_dom", "off_market_in_two_weeks", "inventory_yoy", "median_sale_price_yoy"], 3)}
    path = _tracker_csv(spark, tmp_path, rename=rename, extra=extra)
    grid = {"maxDepth": [2]} if family == "tree" else {"maxDepth": [2], "maxIter": [2]}
    out = workflows.reference_workflow(spark, path, family, keys=keys, grid=grid)
    assert out["comparison"].count() == 3
    with pytest.raises(ValueError, match="no such key"):
        workflows.reference_workflow(spark, path, family, keys=["regoin"], grid=grid)


def test_tree_stump_is_best_midpoint(spark, train):
    n = train.agg(F.count_distinct("median_list_price")).first()[0]
    root = models.tree_root(models.fit(train, "tree", ["median_list_price"], LABEL,
                                       maxDepth=1, maxBins=n + 1))
    pdf = train.select("median_list_price", LABEL).toPandas().sort_values("median_list_price")
    xs = sorted(set(pdf["median_list_price"]))
    thr = root["threshold"]
    assert any(thr == (a + b) / 2 for a, b in zip(xs, xs[1:]))
    left = pdf[pdf["median_list_price"] <= thr]
    assert root["n_left"] == len(left) and root["left_prediction"] == pytest.approx(left[LABEL].mean())


def test_tree_stump_without_a_split(spark):
    from marketml import registry
    from tests.conftest import SF_SMALL

    prepared = workflows.Prepared(SF_SMALL)
    prepared.market = workflows.market_table(spark, SF_SMALL).withColumn("median_list_price", F.lit(31000.0))
    assert registry.QUERIES["tree_stump"](spark, prepared).collect() == []


def test_cross_validation_fold_metrics(spark, train):
    pipe = models.pipeline("linear", ["median_list_price"], LABEL)
    maps = tuning.grid(pipe.getStages()[-1], {"regParam": [0.1, 2000.0], "elasticNetParam": [0.0, 1.0]})
    assert len(tuning.grid_rows(maps)) == 4
    cv = tuning.cross_validate(pipe, maps, train, LABEL, "fold", 3, parallelism=2, collect_sub_models=True)
    fm = tuning.fold_metrics(cv, train, "fold", LABEL).toPandas()
    avg = fm.groupby("point")["rmse"].mean().sort_index().tolist()
    assert avg == pytest.approx(list(cv.avgMetrics), rel=1e-10)
    assert tuning.best_index(cv.avgMetrics) == min(range(4), key=lambda i: cv.avgMetrics[i])


def test_train_validate_is_deterministic(spark, train):
    pipe = models.pipeline("linear", ["median_list_price"], LABEL)
    maps = tuning.grid(pipe.getStages()[-1], {"regParam": [0.1, 2000.0]})
    a = tuning.train_validate(pipe, maps, train, LABEL, "is_validation")
    b = tuning.train_validate(pipe, maps, train.repartition(5), LABEL, "is_validation")
    assert a.best_index == b.best_index
    assert [m["rmse"] for m in a.metrics] == pytest.approx([m["rmse"] for m in b.metrics], rel=1e-12)


def test_reference_random_tvs_runs(spark, train):
    pipe = models.pipeline("linear", ["median_list_price"], LABEL)
    maps = tuning.grid(pipe.getStages()[-1], {"regParam": [0.1, 2000.0]})
    m = tuning.train_validation_split(pipe, maps, train, LABEL, seed=42)
    assert len(m.validationMetrics) == 2


def test_run_family_report(spark, frame):
    run = workflows.run_family(frame, "linear", FEATURES, LABEL,
                               grid={"regParam": [0.1], "elasticNetParam": [0.0, 1.0]})
    cmp_ = report.comparison(spark, run.runs)
    rows = {r.model: r for r in cmp_.collect()}
    assert set(rows) == {"linear", "linear_cv", "linear_tvs"}
    assert rows["linear"].best_params is None and rows["linear_cv"].best_reg_param == 0.1
    assert len({r.n for r in rows.values()}) == 1  # all scored on the same holdout
    status = report.stage_status(cmp_).collect()
    assert {r.status for r in status} == {"Completed"}
    best = report.best_by(cmp_, "rmse", ["model"]).first()
    assert best.rmse == min(r.rmse for r in rows.values())


def test_coefficients_table(spark, train):
    feats = ["median_list_price", "homes_sold"]
    model = models.fit(train, "linear", feats, LABEL)
    sds = models.feature_stddevs(train, feats)
    tab = {r.term: r for r in models.coefficients(spark, model, feats, sds).collect()}
    assert set(tab) == {"intercept", *feats}
    lr = models.regressor(model)
    assert tab["homes_sold"].coefficient == lr.coefficients[1]
    assert tab["homes_sold"].std_coefficient == pytest.approx(lr.coefficients[1] * sds["homes_sold"])


def test_grouped_metrics(spark, train):
    df = train.withColumn("prediction", F.col(LABEL) * 0.9)
    g = regression_metrics(df, LABEL, group_cols=["fold"]).collect()
    assert sum(r.n for r in g) == train.count()


def test_reference_style_csv_workflow(spark, tmp_path):
    """A reference user's path: dirty CSV with inferred schema -> guarded
    cast -> drop -> report with a tuned model."""
    from marketml.operators.clean import prepare
    from marketml.sources.tables import read_csv, write_csv

    market = workflows.market_table(spark, SF)
    dirty = market.select(
        "region_id", "period_begin",
        F.when(F.col("homes_sold") % 17 == 0, F.lit("N/A"))
         .otherwise(F.col("median_list_price").cast("string")).alias("median_list_price"),
        F.col("homes_sold").cast("string").alias("homes_sold"),
        F.col(LABEL).cast("string").alias(LABEL))
    path = str(tmp_path / "tracker")
    write_csv(dirty, path)
    raw = read_csv(spark, path, infer_schema=True)
    feats = ["median_list_price", "homes_sold"]
    df = prepare(raw, feats, LABEL, keys=["region_id", "period_begin"], mode="digits_only")
    assert df.count() == market.where(F.col("homes_sold") % 17 != 0).count()
    out = workflows.regression_report(spark, df, feats, LABEL, "tree", ["region_id", "period_begin"],
                                      grid={"maxDepth": [2, 4]}, folds=2)
    assert out["comparison"].count() == 3
    assert out["candidates"].where("is_best").count() == 1
    imp = out["importance"].where("source_model = 'tree'").orderBy("rank").collect()
    assert imp[0].feature == "median_list_price" and sum(r.importance for r in imp) == pytest.approx(1.0)
    cv_imp = out["importance"].where("source_model = 'tree_cv'").collect()
    assert len(cv_imp) == 2 and sum(r.importance for r in cv_imp) == pytest.approx(1.0)


def test_scratch_scope_deletes_intermediates(spark):
    import os

    from marketml.session import materialize, scratch_scope

    with scratch_scope(spark) as paths:
        materialize(spark.range(10), "scope-test").count()
        local = [p.replace("file:", "") for p in paths]
        assert all(os.path.exists(p) for p in local)
    assert not any(os.path.exists(p) for p in local)


def _tracker_csv(spark, tmp_path, rename=None, extra=None):
    from marketml.sources.tables import write_csv

    m = workflows.market_table(spark, SF)
    cols = [F.col(c).alias((rename or {}).get(c, c)) for c in m.columns]
    cols += [e.alias(n) for n, e in (extra or {}).items()]
    path = str(tmp_path / "tracker")
    write_csv(m.select(*cols), path)
    return path


def test_reference_workflow_forest_and_tree(spark, tmp_path):
    path = _tracker_csv(spark, tmp_path / "f")
    out = workflows.reference_workflow(spark, path, "forest", keys=["region_id", "period_begin"])
    assert {"comparison", "status", "importance", "candidates"} <= set(out)
    assert out["comparison"].count() == 3
    path = _tracker_csv(spark, tmp_path / "t", rename={LABEL: "median_sale_price13"},
                        extra={"PERIOD_BEGIN59": F.col("period_begin")})
    out = workflows.reference_workflow(spark, path, "tree", grid={"maxDepth": [2, 3]})
    best = out["comparison"].where("model = 'tree_cv'").first()
    assert best.best_max_depth in (2, 3)


def test_reference_workflow_gbt_with_eda_and_ablation(spark, tmp_path):
    c = F.col
    extra = {
        "pending_sales": c("new_listings"), "months_of_supply": c("inventory") / c("homes_sold"),
        "median_list_ppsf": c("median_ppsf"), "price_drops": c("homes_sold") % 5,
        "sold_above_list": c("new_listings") % 3, "median_dom": c("homes_sold") % 11,
        "off_market_in_two_weeks": c("inventory") % 7, "inventory_yoy": c("inventory") / 100,
        "median_sale_price_yoy": c("avg_sale_to_list"),
    }
    path = _tracker_csv(spark, tmp_path / "g", extra=extra)
    out = workflows.reference_workflow(spark, path, "gbt", keys=["region_id", "period_begin"],
                                       grid={"maxDepth": [2], "maxIter": [3]})
    abl = {r.feature_set: r for r in out["ablation"].collect()}
    assert set(abl) == {"all", "without_median_list_price"} and abl["all"].rmse_change == 0
    assert out["series_head"].count() == 10
    assert out["correlation"].count() == 16 * 17 // 2
    assert out["summary"].count() == 5


@pytest.mark.parametrize("family", ["linear", "tree", "forest", "gbt"])
def test_prediction_invariants(spark, train, test_rows, family):
    tr = models.canonical(train)
    params = {"maxIter": 5} if family == "gbt" else {}
    pred = models.fit(tr, family, FEATURES, LABEL, **params).transform(test_rows)
    m = metrics_dict(pred, LABEL)
    assert m["n"] == test_rows.count()
    assert m["r2"] <= 1.0 and m["rmse"] >= 0.0
    assert pred.where(F.col("prediction").isNull()).count() == 0


def test_same_seed_same_boosted_predictions(spark, train, test_rows):
    def run():
        tr = models.canonical(train)
        p = models.fit(tr, "gbt", FEATURES, LABEL, maxIter=5, subsamplingRate=0.7)
        return sorted(r.prediction for r in p.transform(test_rows).select("prediction").collect())

    assert run() == run()


def test_reference_workflow_linear_preset(spark, tmp_path):
    c = F.col
    extra = {
        "pending_sales": c("new_listings"), "months_of_supply": c("inventory") / c("homes_sold"),
        "median_dom": c("homes_sold") % 11, "sold_above_list": c("new_listings") % 3,
        "price_drops": c("homes_sold") % 5, "off_market_in_two_weeks": c("inventory") % 7,
    }
    path = _tracker_csv(spark, tmp_path / "l", extra=extra)
    out = workflows.reference_workflow(spark, path, "linear", keys=["region_id", "period_begin"],
                                       grid={"regParam": [0.1], "elasticNetParam": [0.0, 1.0]})
    imp = out["importance"].collect()
    assert len(imp) == 12 and imp[0].abs_coefficient >= imp[-1].abs_coefficient
    assert {r.status for r in out["status"].collect()} == {"Completed"}


def test_sf001_full_sample_two_feature_fit(spark, frame):
    feats = ["median_list_price", "homes_sold"]
    model = models.fit(frame, "linear", feats, LABEL)
    lr = models.regressor(model)
    assert list(lr.coefficients) == pytest.approx([0.93742937, 2.57701839], abs=1e-8)
    assert lr.intercept == pytest.approx(570.61128, abs=1e-4)
    assert metrics_dict(model.transform(frame), LABEL)["r2"] == pytest.approx(0.98458, abs=1e-5)


def test_cli_runs_a_reference_script(spark, tmp_path, capsys):
    from marketml.__main__ import main

    path = _tracker_csv(spark, tmp_path / "cli")
    out = str(tmp_path / "out")
    assert main(["forest", path, "--keys", "region_id,period_begin", "--no-tune", "--out", out, "--rows", "3"]) == 0
    text = capsys.readouterr().out
    assert "=== comparison ===" in text and "=== importance ===" in text
    assert spark.read.parquet(f"{out}/importance").count() == 4


def test_imputer_takes_means_from_training_rows(spark):
    rows = [(1.0, 2.0), (3.0, 6.0), (None, 4.0), (float("nan"), 4.0)]
    train = spark.createDataFrame(rows, "x double, y double")
    model = models.fit(train, "linear", ["x"], "y", impute=True)
    far = spark.createDataFrame([(None, 0.0), (1000.0, 0.0)], "x double, y double")
    got = [r.prediction for r in model.transform(far).collect()]
    assert got == pytest.approx([4.0, 2000.0])  # 2 is the mean of the training rows, whatever the others hold


def test_forest_workflow_keeps_rows_with_missing_features(spark, tmp_path):
    m = workflows.market_table(spark, SF)
    gaps = m.withColumn("inventory", F.when(F.col("homes_sold") % 5 > 0, F.col("inventory")))
    path = str(tmp_path / "gaps")
    gaps.write.parquet(path)
    out = workflows.reference_workflow(spark, path, "forest", fmt="parquet", keys=KEYS, tune=False)
    full = workflows.model_frame(m).where("split = 'test'").count()
    n = out["comparison"].first().n
    assert abs(n - full) < full / 4 and n > m.count() * 0.1


@pytest.mark.parametrize("family", ["linear", "gbt"])
def test_predict_each_equals_each_model(spark, train, test_rows, family):
    feats = [["median_list_price"], ["homes_sold", "median_list_price"]]
    params = {"maxIter": 2} if family == "gbt" else {}
    fitted = [models.fit(train, family, f, LABEL, **params) for f in feats]
    got = models.predict_each(fitted, test_rows, KEYS).collect()
    want = {(i, r.region_id, r.period_begin): r.prediction
            for i, m in enumerate(fitted) for r in m.transform(test_rows).select(*KEYS, "prediction").collect()}
    assert {(r.point, r.region_id, r.period_begin): r.prediction for r in got} == want and len(got) == len(want)


def test_random_train_validation_repeats(spark):
    from marketml.registry import LINEAR_GRID, QUERIES

    with workflows.prepared_market(spark, SF) as sf:
        a, b = (QUERIES["linreg_random_tvs"](spark, sf).first() for _ in range(2))
    assert a == b and a.best_reg_param in LINEAR_GRID["regParam"] and a.r2 > 0.9


@pytest.mark.parametrize("name", ["market_base", "csv_roundtrip", "summary_by_level", "linreg_cv", "tree_importance"])
def test_a_scope_leaves_no_scratch(spark, name):
    import os

    from marketml.registry import QUERIES
    from marketml.session import checkpoint_dir, scratch_scope

    folder = checkpoint_dir(spark).replace("file:", "") + "/marketml"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    with scratch_scope(spark):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert set(os.listdir(folder)) <= before


def test_levels_add_up_from_nations(spark):
    from marketml.sources import market as mk

    rolled = mk.build_market_levels(spark, "/root/testdata/sf0.001", "month").collect()
    plain = mk.aggregate_market(mk.market_facts(spark, "/root/testdata/sf0.001", "month", mk.LEVELS)).collect()
    assert sorted(map(str, rolled)) == sorted(map(str, plain))


def _made(spark, n=240):
    """Rows with two features, a label, a key, a split, a fold and a validation flag."""
    rows = spark.range(n).select(F.col("id").alias("row_key"), (F.col("id") * 7 % 31).cast("double").alias("a"), (F.col("id") * 5 % 17).cast("double").alias("b"),
                                 (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 5 == 0).alias("is_validation"), F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    return rows.withColumn("y", F.col("a") * 2 + F.col("b") * F.col("b"))


def test_ablation_fits_run_side_by_side(spark, monkeypatch):
    import threading

    meet, fit = threading.Barrier(2), models.fit

    def both(*args, **how):
        meet.wait(60)
        return fit(*args, **how)

    monkeypatch.setattr(models, "fit", both)
    got = {r.feature_set: r for r in workflows.ablation_report(spark, _made(spark), "tree", ["a", "b"], "y", ["b"]).collect()}
    assert got["all"].n == got["without_b"].n == 60 and got["all"].rmse < got["without_b"].rmse


def test_points_of_a_grid_share_the_stages_before_the_last(spark, monkeypatch):
    from marketml.operators import binning

    df, seen, edges = _made(spark), [], binning.quantile_edges
    monkeypatch.setattr(binning, "quantile_edges", lambda *a: seen.append(1) or edges(*a))
    pipe = models.pipeline("gbt", ["a", "b"], "y", binned=True, maxIter=2)
    maps = tuning.grid(pipe.getStages()[-1], {"maxDepth": [1, 3], "maxIter": [2]})
    cv = tuning.fold_cross_validate(pipe, maps, df, "y", "fold", 3)
    assert len(seen) == 4  # three folds and the last fit
    seen.clear()
    tvs = tuning.train_validate(pipe, maps, df, "y", "is_validation")
    assert len(seen) == 2
    # The same scores as fits of whole pipelines.
    for i, m in enumerate(maps):
        for f in range(3):
            alone = metrics_dict(pipe.fit(df.where(F.col("fold") != f), m).transform(df.where(F.col("fold") == f)), "y")
            assert cv.folds[3 * i + f]["rmse"] == alone["rmse"]
        alone = metrics_dict(pipe.fit(df.where(~F.col("is_validation")), m).transform(df.where("is_validation")), "y")
        assert tvs.metrics[i]["rmse"] == alone["rmse"]
