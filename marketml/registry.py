"""Registered queries (one per SURVEY section 2 operator group) and their
DuckDB SQL oracles.

Every query reads the synthetic tables (or the market table Spark derives
from them) in full.  Values that two engines can compute with different
floating-point summation order are rounded the same way on both sides:
8 places for unit-scale numbers (R^2, slopes, correlations), 4 for
price-scale ones (RMSE, intercepts, means).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.functions.scalar import elapsed_hms, to_double
from marketml.operators import binning, clean, evaluate, features, moments, profile, split
from marketml.operators.quantiles import exact_quantiles
from marketml.plans import ensembles, models, report, tuning, workflows
from marketml.session import materialize, scratch_path, write_scratch
from marketml.sources import market as mk
from marketml.sources import tables

LABEL = mk.LABEL
X1 = "median_list_price"
X2 = "homes_sold"
LIN1 = [X1]
LIN2 = [X1, X2]
ALL = mk.FEATURES
MODEL_COLS = [*ALL, LABEL]
# Fixed value: the reference's linear grid, plus regParam 2000 to spread
# the candidates' scores.
LINEAR_GRID = {"regParam": [0.01, 0.1, 2000.0], "elasticNetParam": [0.0, 0.5, 1.0]}
FOLDS = 3

MARKET_SCHEMA = T.StructType([
    T.StructField("region_id", T.IntegerType()),
    T.StructField("period_begin", T.DateType()),
    T.StructField("homes_sold", T.LongType()),
    T.StructField("new_listings", T.LongType()),
    T.StructField("inventory", T.DoubleType()),
    T.StructField("median_list_price", T.DoubleType()),
    T.StructField("median_ppsf", T.DoubleType()),
    T.StructField("median_sale_price", T.DoubleType()),
    T.StructField("avg_sale_to_list", T.DoubleType()),
])

R4 = 4
R8 = 8

# ---------------------------------------------------------------------------
# shared inputs


def _market(spark, sf):
    """The market of a folder of tables, or the one that the caller has prepared."""
    return sf.market if isinstance(sf, workflows.Prepared) else workflows.market_table(spark, sf)


def _frame(spark, sf):
    return workflows.model_frame(_market(spark, sf), folds=FOLDS)


def _train_test(spark, sf):
    fr = _frame(spark, sf)
    return fr.where(F.col("split") == "train"), fr.where(F.col("split") == "test")


def _dirty(spark, sf) -> DataFrame:
    """lineitem with dirt injected by line number: text numbers that do not
    parse, a negative, a NULL discount (0 -> NULL) and a NaN tax."""
    li = tables.load(spark, sf, "lineitem")
    qty = F.col("l_quantity").cast("long").cast("string")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price_text = F.concat(
        F.floor(cents / 100).cast("long").cast("string"), F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"))
    ln = F.col("l_linenumber")
    qty_text = (F.when(ln == 1, "N/A").when(ln == 2, "").when(ln == 3, "1.2.3")
                .when(ln == 4, F.concat(F.lit("-"), qty)).when(ln == 5, ".").otherwise(qty))
    return li.select(
        "l_orderkey", "l_linenumber",
        qty_text.alias("qty_text"), price_text.alias("price_text"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        F.when(ln == 7, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax"),
    )


def _dirty_numeric(spark, sf) -> DataFrame:
    d = _dirty(spark, sf)
    return d.select("l_orderkey", "l_linenumber",
                    to_double("qty_text").alias("quantity"),
                    to_double("price_text").alias("price"), "discount", "tax")


def _r(c, n):
    return F.round(F.col(c), n).alias(c)


def _fit_many(est, maps, df, parallelism=4):
    """Fit every param map (parallel driver threads); list in map order."""
    tasks = est.fitMultiple(df, maps)
    with ThreadPool(parallelism) as pool:
        got = dict(pool.imap_unordered(lambda _: next(tasks), range(len(maps))))
    return [got[i] for i in range(len(maps))]


def _linear_grid(est):
    return tuning.grid(est, LINEAR_GRID)


def _grid_array(maps):
    """The linear grid as an array literal of (point, reg_param,
    elastic_net_param) structs, attached to rows with explode/element_at."""
    return F.array(*[
        F.struct(F.lit(i).alias("point"), F.lit(r["regParam"]).alias("reg_param"),
                 F.lit(r["elasticNetParam"]).alias("elastic_net_param"))
        for i, r in enumerate(tuning.grid_rows(maps))
    ])


# ---------------------------------------------------------------------------
# 1 sources


def q_market_base(spark, sf):
    """Market table, nation x month (fixture; S5 scans, joins, sums, exact medians)."""
    return mk.build_market(spark, sf, "month")


def q_scan_select(spark, sf):
    """Generic-format scan with a declared schema, tolerant drop, select."""
    df = tables.read_table(spark, tables.table_path(sf, "lineitem"), "parquet",
                           schema=tables.SCHEMAS["lineitem"])
    df = tables.drop_columns(df, ["l_comment", "l_shipinstruct", "l_tax", "l_shipdate"])
    return clean.select_columns(df, ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"])


def q_csv_roundtrip(spark, sf):
    """Write the market as CSV to the shared folder and scan it back with a schema."""
    path = scratch_path(spark, "market-csv")
    tables.write_csv(_market(spark, sf), path)
    return tables.read_csv(spark, path, schema=MARKET_SCHEMA)


def q_sql_view(spark, sf):
    """Temp view + SQL over it."""
    name = f"market_{uuid.uuid4().hex}"  # no view of the caller's has this name
    _market(spark, sf).createTempView(name)
    out = spark.sql(f"SELECT * FROM {name}")
    spark.catalog.dropTempView(name)  # the query is resolved by now
    return out


def q_schema_table(spark, sf):
    """Schema with non-NULL counts."""
    return profile.schema_table(_market(spark, sf))


def q_union_levels(spark, sf):
    """Nation, region and national levels in one table."""
    return mk.build_market_levels(spark, sf, "month")


# ---------------------------------------------------------------------------
# 2 cleaning


def q_clean_regex_cast(spark, sf):
    """Digits-only guarded cast of dirty text."""
    d = _dirty(spark, sf)
    return d.select("l_orderkey", "l_linenumber", "qty_text",
                    to_double("qty_text", "digits_only").alias("quantity"),
                    to_double("price_text", "digits_only").alias("price"))


def q_clean_try_cast(spark, sf):
    """ANSI-safe cast of dirty text."""
    d = _dirty(spark, sf)
    return d.select("l_orderkey", "l_linenumber", "qty_text",
                    to_double("qty_text", "try_cast").alias("quantity"),
                    to_double("price_text", "try_cast").alias("price"))


def q_drop_null_any(spark, sf):
    """Drop rows with NULL or NaN in any column."""
    return clean.drop_missing(_dirty_numeric(spark, sf))


def q_drop_null_subset(spark, sf):
    """Drop rows with NULL or NaN in a subset."""
    return clean.drop_missing(_dirty_numeric(spark, sf), ["quantity", "tax"])


def q_impute_mean(spark, sf):
    """Drop on the label, impute features with their mean (P10)."""
    d = clean.drop_missing(_dirty_numeric(spark, sf), ["price"])
    out = clean.impute_mean(d, ["quantity", "discount", "tax"])
    return out.select("l_orderkey", "l_linenumber", "price",
                      _r("quantity", R8), _r("discount", R8), _r("tax", R8))


# ---------------------------------------------------------------------------
# 3 profiling


def q_row_count(spark, sf):
    """Row count (G1)."""
    return profile.row_count(_market(spark, sf))


def q_null_profile(spark, sf):
    """NULL count per column."""
    return profile.null_profile(_dirty_numeric(spark, sf), ["quantity", "price", "discount", "tax"])


TEXT_COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


def q_describe_text(spark, sf):
    """describe over text, date and number columns: text has count, min, max."""
    d = profile.describe(spark.read.parquet(tables.table_path(sf, "orders")), TEXT_COLUMNS)
    return d.select("column_name", "count", _r("mean", R4), _r("stddev", R4), "min", "max")


def q_csv_inferred(spark, sf):
    """CSV with inferred types and two headers that repeat but for case."""
    path = scratch_path(spark, "market-inferred-csv")
    copy = write_scratch(_market(spark, sf).select("region_id", "median_list_price", "median_sale_price"), "market-prices")
    # The writer refuses such headers unless names are case-sensitive: a session of its own, so the caller's stays as it is.
    own = spark.newSession()
    own.conf.set("spark.sql.caseSensitive", "true")
    tables.write_csv(own.read.parquet(copy).toDF("region_id", "price", "PRICE"), path)
    df = tables.read_csv_typed(spark, path)
    return df.select("region_id", F.col("price1").alias("list_price"), F.col("PRICE2").alias("sale_price"))


def q_levels_from_files(spark, sf):
    """One CSV file a level, one of them without a column, read and stacked."""
    levels = materialize(mk.build_market_levels(spark, sf, "month"), "market-levels")
    paths = {}
    for lv in mk.LEVELS:
        part = levels.where(F.col("region_level") == lv).select("region_id", "period_begin", "homes_sold", "inventory", LABEL)
        paths[lv] = scratch_path(spark, f"level-{lv}")
        tables.write_csv(part.drop("inventory") if lv == "all" else part, paths[lv])
    df = tables.load_levels(spark, paths)
    return df.select("region_level", "region_id", "period_begin", F.col("homes_sold").cast("long").alias("homes_sold"), "inventory", LABEL)


def q_market_bracket(spark, sf):
    """Market table with medians by the bracket method, chosen by name (sort is the default)."""
    return mk.build_market(spark, sf, "month", quantile_method="bracket")


def q_linreg_all_first_order(spark, sf):
    """All-feature least squares: at the optimum the residuals are uncorrelated
    with every feature and sum to zero (R1)."""
    train, _ = _train_test(spark, sf)
    p = models.fit(train, "linear", ALL, LABEL).transform(train).withColumn("e", F.col(LABEL) - F.col("prediction"))
    cov = lambda f: F.avg(F.col("e") * F.col(f)) / (F.stddev_pop(F.col(f)) * F.stddev_pop(F.col(LABEL)))
    wide = p.agg(F.count(F.lit(1)).alias("n"), (F.avg("e") / F.stddev_pop(F.col(LABEL))).alias("intercept"), *[cov(f).alias(f) for f in ALL])
    rows = F.array(*[F.struct(F.lit(t).alias("term"), (F.round(F.abs(F.col(t)), 6) + 0.0).alias("gradient")) for t in ["intercept", *ALL]])
    return wide.select("n", F.explode(rows).alias("r")).select("r.term", "n", "r.gradient")


def _linear_runs(spark, sf):
    run = workflows.run_family(_frame(spark, sf), "linear", LIN1, LABEL, grid=LINEAR_GRID, folds=FOLDS)
    return report.comparison(spark, run.runs)


def q_comparison_values(spark, sf):
    """Baseline, CV and TVS compared with their chosen parameters, without times (O1, O2)."""
    return _linear_runs(spark, sf).select("model", "eval_on", "n", _r("rmse", R4), _r("r2", R8), "best_reg_param", "best_elastic_net_param")


def q_stage_status_values(spark, sf):
    """Stage completion table without times."""
    return report.stage_status(_linear_runs(spark, sf)).select("stage", "status", "rmse_text", "r2_text")


def q_describe(spark, sf):
    """count, mean, stddev, min, max per column."""
    d = profile.describe(_market(spark, sf), MODEL_COLS)
    return d.select("column_name", "count", _r("mean", R4), _r("stddev", R4), "min", "max")


def q_summary_quartiles(spark, sf):
    """describe + exact quartiles."""
    s = profile.summary(_market(spark, sf), MODEL_COLS)
    return s.select("column_name", "count", _r("mean", R4), _r("stddev", R4), "min",
                    _r("p25", R4), _r("p50", R4), _r("p75", R4), "max")


def q_correlation_matrix(spark, sf):
    """Pairwise correlations."""
    c = profile.correlation_matrix(_market(spark, sf), MODEL_COLS)
    return c.select("col_a", "col_b", _r("corr", R8))


def q_series_head(spark, sf):
    """First rows in time order (A1, A2)."""
    return profile.series_head(_market(spark, sf), "period_begin", [LABEL], 10, ["region_id"])


# ---------------------------------------------------------------------------
# 4 split and features


def q_hash_split_counts(spark, sf):
    """Rows per side of the key-hash split (M2, M3)."""
    return split.split_counts(_frame(spark, sf))


def q_random_split_counts(spark, sf):
    """Rows per side of the reference's randomSplit (M2, M3)."""
    tr, te = split.random_split(_market(spark, sf), (0.8, 0.2), 42)
    both = tr.select(F.lit("train").alias("split")).unionByName(te.select(F.lit("test").alias("split")))
    return split.split_counts(both)


def q_fold_counts(spark, sf):
    """Rows per cross-validation fold."""
    return split.split_counts(_frame(spark, sf), "fold")


def q_assemble_vector(spark, sf):
    """Feature vector as (feature, value) rows."""
    m = features.assemble(_market(spark, sf), ALL)
    return features.vector_long(m, mk.KEYS, ALL)


# ---------------------------------------------------------------------------
# 5 linear models


def _coef_query(spark, sf, feats):
    train, _ = _train_test(spark, sf)
    model = models.fit(train, "linear", feats, LABEL)
    sds = models.feature_stddevs(train, feats)
    c = models.coefficients(spark, model, feats, sds)
    return c.select("term", _r("coefficient", R4), _r("abs_coefficient", R4), _r("std_coefficient", R4))


def q_linreg_1f_coef(spark, sf):
    """One-feature linear fit: coefficient table."""
    return _coef_query(spark, sf, LIN1)


def q_linreg_2f_coef(spark, sf):
    """Two-feature linear fit: coefficient table."""
    return _coef_query(spark, sf, LIN2)


def _holdout(pred):
    m = evaluate.regression_metrics(pred, LABEL)
    return m.select("n", _r("rmse", R4), _r("r2", R8), _r("mae", R4))


def q_linreg_holdout_metrics(spark, sf):
    """Holdout n, RMSE, R^2, MAE of the linear fit."""
    train, test = _train_test(spark, sf)
    model = models.fit(train, "linear", LIN1, LABEL)
    return _holdout(model.transform(test))


def q_linreg_predictions(spark, sf):
    """Holdout predictions of the linear fit."""
    train, test = _train_test(spark, sf)
    model = models.fit(train, "linear", LIN1, LABEL)
    return model.transform(test).select(*mk.KEYS, LABEL, _r("prediction", R4))


def _elastic_net_table(spark, sf):
    train, test = _train_test(spark, sf)
    pipe = models.pipeline("linear", LIN1, LABEL)
    maps = _linear_grid(pipe.getStages()[-1])
    train = train.persist()
    fitted = _fit_many(pipe, maps, train)
    train.unpersist()
    met = evaluate.regression_metrics(models.predict_each(fitted, test, [LABEL]), LABEL, group_cols=["point"])
    lines = [models.regressor(m) for m in fitted]
    line = F.element_at(F.array(*[
        F.struct(F.lit(float(lr.coefficients[0])).alias("slope"), F.lit(float(lr.intercept)).alias("intercept"))
        for lr in lines]), F.col("point") + 1)
    g = F.element_at(_grid_array(maps), F.col("point") + 1)
    return met.select(g["reg_param"].alias("reg_param"), g["elastic_net_param"].alias("elastic_net_param"),
                      line["slope"].alias("slope"), line["intercept"].alias("intercept"), "n", "rmse", "r2", "mae")


def q_elastic_net_metrics(spark, sf):
    """Holdout metrics and coefficients for every elastic-net grid point."""
    t = _elastic_net_table(spark, sf)
    return t.select("reg_param", "elastic_net_param", _r("slope", R8), _r("intercept", R4),
                    _r("rmse", R4), _r("r2", R8))


# ---------------------------------------------------------------------------
# 6 trees


# Features with a fixed number of levels, so that a tree's default 32 bins hold
# every midpoint and its splits are exact at any size of the data.
STEPS = ["price_step", "ppsf_step"]


def _steps(spark, sf):
    """The model frame with two prices in at most 31 fixed steps each."""
    step = lambda c, width: F.greatest(F.lit(0.0), F.least(F.lit(30.0), F.floor(F.col(c) / width).cast("double")))
    return _frame(spark, sf).withColumns({"price_step": step(X1, 15000), "ppsf_step": step("median_ppsf", 250)})


def _steps_fit(spark, sf, family, feats=STEPS, **params):
    df = _steps(spark, sf)
    return models.fit(df.where("split = 'train'"), family, feats, LABEL, **params), df.where("split = 'test'")


def q_tree_stump(spark, sf):
    """Depth-1 tree: the exact best split of the price steps (R3); no row where all prices lie in one step."""
    model, _ = _steps_fit(spark, sf, "tree", STEPS[:1], maxDepth=1)
    root = models.tree_root(model)
    rows = [(STEPS[root["feature_index"]], root["threshold"], root["left_prediction"],
             root["right_prediction"], root["n_left"], root["n_right"])] if root else []
    return spark.createDataFrame(
        rows, "feature string, threshold double, left_mean double, right_mean double, "
               "n_left long, n_right long",
    ).select("feature", _r("threshold", R4), _r("left_mean", R4), _r("right_mean", R4),
             "n_left", "n_right")


def q_tree_exact_metrics(spark, sf):
    """Depth-3 tree on the stepped features: holdout metrics."""
    model, test = _steps_fit(spark, sf, "tree", maxDepth=3)
    return _holdout(model.transform(test))


def q_tree_exact_importance(spark, sf):
    """Importances of the depth-3 tree on the stepped features."""
    model, _ = _steps_fit(spark, sf, "tree", maxDepth=3)
    return models.importances(spark, model, STEPS, "tree").select("feature", _r("importance", R8), "rank")


def q_forest_one_tree(spark, sf):
    """A forest of one tree without resampling and with every feature is that tree."""
    model, test = _steps_fit(spark, sf, "forest", numTrees=1, bootstrap=False, subsamplingRate=1.0,
                             featureSubsetStrategy="all", maxDepth=3)
    return _holdout(model.transform(test))


def q_gbt_two_iterations(spark, sf):
    """Two boosting iterations: a tree and a tree of its residuals."""
    model, test = _steps_fit(spark, sf, "gbt", maxIter=2, maxDepth=2, stepSize=0.1)
    return _holdout(model.transform(test))


# Fixed value: depths 1 to 3, in the order in which ties are resolved.
DEPTHS = [1, 2, 3]


def _depth_tuning(spark, sf, which):
    """(chosen depth, its tuning RMSE, holdout metrics) of the tree on the stepped features."""
    df = _steps(spark, sf)
    train, test = df.where("split = 'train'").persist(), df.where("split = 'test'")
    pipe = models.pipeline("tree", STEPS, LABEL)
    maps = tuning.grid(pipe.getStages()[-1], {"maxDepth": DEPTHS})
    if which == "cv":
        model = tuning.nested_cross_validate(pipe, maps, train, LABEL, "fold", FOLDS, parallelism=3)
        scores, model = list(model.avgMetrics), model.bestModel
    else:
        res = tuning.nested_train_validate(pipe, maps, train, LABEL, "is_validation")
        scores, model = [m["rmse"] for m in res.metrics], res.model
    train.unpersist()
    depth = models.param_values(model, ["maxDepth"])["maxDepth"]  # read off the refitted model (R11)
    return _holdout(model.transform(test)).select(
        F.lit(int(depth)).alias("best_max_depth"), F.round(F.lit(float(min(scores))), R4).alias("tuning_rmse"),
        "n", "rmse", "r2")


def q_tree_exact_cv(spark, sf):
    """Tree depth by cross-validation on the stepped features."""
    return _depth_tuning(spark, sf, "cv")


def q_tree_exact_tvs(spark, sf):
    """Tree depth by train-validation on the stepped features."""
    return _depth_tuning(spark, sf, "tvs")


def q_linreg_imputed(spark, sf):
    """Price by quantity over dirty lines, missing quantities filled inside the
    pipeline with the mean of the training rows (P10, M1, R1, R7)."""
    d = clean.drop_missing(_dirty_numeric(spark, sf).drop("discount", "tax"), ["price"])
    # Unlike the market key, a line's key has no other use than the split.
    d = split.with_split(d, F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    model = models.fit(d.where("split = 'train'"), "linear", ["quantity"], "price", impute=True)
    m = evaluate.regression_metrics(model.transform(d.where("split = 'test'")), "price")
    return m.select("n", _r("rmse", R4), _r("r2", R8), _r("mae", R4))


#: Three trees that try all of their features at every node, so that no generator of MLlib takes part.
THREE_TREES = {"numTrees": 3, "featureSubsetStrategy": "all", "featureShare": 0.8}


def _family_baseline(spark, sf, family, **params):
    """The family's seeded baseline fit on quantile levels."""
    train, test = _train_test(spark, sf)
    train = train.persist()
    model = models.fit(train, family, ALL, LABEL, binned=True, **params)
    train.unpersist()
    return model, test


def q_tree_d5_metrics(spark, sf):
    """Depth-5 tree holdout metrics."""
    model, test = _family_baseline(spark, sf, "tree")
    return _holdout(model.transform(test))


def q_forest_metrics(spark, sf):
    """Random forest holdout metrics."""
    model, test = _family_baseline(spark, sf, "forest")
    return _holdout(model.transform(test))


def q_forest_three_trees(spark, sf):
    """Three resampled trees, each on four features chosen by hash."""
    model, test = _family_baseline(spark, sf, "forest", **THREE_TREES)
    return _holdout(model.transform(test))


def q_gbt_metrics(spark, sf):
    """Boosted trees holdout metrics."""
    model, test = _family_baseline(spark, sf, "gbt")
    return _holdout(model.transform(test))


def q_gbt_100_metrics(spark, sf):
    """Boosted trees, 100 iterations."""
    model, test = _family_baseline(spark, sf, "gbt", maxIter=100)
    return _holdout(model.transform(test))


def q_tree_importance(spark, sf):
    """Tree feature importances, sorted."""
    model, _ = _family_baseline(spark, sf, "tree")
    return models.importances(spark, model, ALL, "tree")


def q_forest_importance(spark, sf):
    """Forest feature importances, sorted."""
    model, _ = _family_baseline(spark, sf, "forest")
    return models.importances(spark, model, ALL, "forest")


def q_gbt_importance(spark, sf):
    """Boosted feature importances, sorted."""
    model, _ = _family_baseline(spark, sf, "gbt")
    return models.importances(spark, model, ALL, "gbt")


# ---------------------------------------------------------------------------
# 7 tuning


def q_param_grid(spark, sf):
    """The grid x folds work plan with fit/eval row counts."""
    train, _ = _train_test(spark, sf)
    pipe = models.pipeline("linear", LIN1, LABEL)
    grid = _grid_array(_linear_grid(pipe.getStages()[-1]))
    counts = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_eval"))
    # A window over the k fold counts (k rows), not over data rows.
    total = F.sum("n_eval").over(Window.partitionBy())
    counts = counts.select("fold", "n_eval", (total - F.col("n_eval")).alias("n_fit"))
    return counts.select(F.explode(grid).alias("g"), "fold", "n_fit", "n_eval").select(
        "g.point", "g.reg_param", "g.elastic_net_param", "fold", "n_fit", "n_eval")


def _linreg_cv(spark, sf, feats=LIN1):
    """Cross-validation of the elastic-net grid, from one scan of the training rows."""
    train, test = _train_test(spark, sf)
    pipe = models.pipeline("linear", feats, LABEL)
    maps = _linear_grid(pipe.getStages()[-1])
    return tuning.linear_cross_validate(pipe, maps, train, feats, LABEL, "fold"), maps, train, test


def q_linreg_cv(spark, sf):
    """Cross-validated elastic net: chosen point, CV RMSE, holdout."""
    cv, maps, _, test = _linreg_cv(spark, sf)
    i = tuning.best_index(cv.avgMetrics)
    best = tuning.grid_rows(maps)[i]
    m = evaluate.regression_metrics(cv.transform(test), LABEL)
    return m.select(
        F.lit(best["regParam"]).alias("best_reg_param"),
        F.lit(best["elasticNetParam"]).alias("best_elastic_net_param"),
        F.round(F.lit(float(cv.avgMetrics[i])), R4).alias("cv_rmse"),
        "n", _r("rmse", R4), _r("r2", R8))


def q_linreg_tvs(spark, sf):
    """Train-validation tuned elastic net."""
    train, test = _train_test(spark, sf)
    pipe = models.pipeline("linear", LIN1, LABEL)
    maps = _linear_grid(pipe.getStages()[-1])
    train = train.persist()
    res = tuning.train_validate(pipe, maps, train, LABEL, "is_validation", parallelism=4)
    train.unpersist()
    best = tuning.grid_rows(maps)[res.best_index]
    m = evaluate.regression_metrics(res.model.transform(test), LABEL)
    return m.select(
        F.lit(best["regParam"]).alias("best_reg_param"),
        F.lit(best["elasticNetParam"]).alias("best_elastic_net_param"),
        F.round(F.lit(float(res.metrics[res.best_index]["rmse"])), R4).alias("validation_rmse"),
        "n", _r("rmse", R4), _r("r2", R8))


def _fold_rmse(spark, sf, feats):
    cv, maps, *_ = _linreg_cv(spark, sf, feats)
    points = tuning.grid_rows(maps)
    rows = [(points[f["point"]]["regParam"], points[f["point"]]["elasticNetParam"], int(f["fold"]), f["n"], f["rmse"]) for f in cv.folds]
    df = spark.createDataFrame(rows, "reg_param double, elastic_net_param double, fold int, n long, rmse double")
    return df.select("reg_param", "elastic_net_param", "fold", "n", _r("rmse", R4))


def q_linreg_cv_fold_rmse(spark, sf):
    """RMSE of every (grid point, fold)."""
    return _fold_rmse(spark, sf, LIN1)


def q_linreg_cv_all_features(spark, sf):
    """RMSE of every (grid point, fold) on all features."""
    return _fold_rmse(spark, sf, ALL)


def q_elastic_net_all_features(spark, sf):
    """Coefficients and holdout scores of the elastic-net grid on all features, from one scan."""
    by_split = moments.moments(_frame(spark, sf), [*ALL, LABEL], "split")
    stage = models.estimator("linear", LABEL)
    rows = []
    for r in tuning.grid_rows(_linear_grid(stage)):
        coef, intercept = moments.solve(by_split["train"], r["regParam"], r["elasticNetParam"])
        s = moments.score(by_split["test"], coef, intercept)
        rows.append((r["regParam"], r["elasticNetParam"], *[float(c) for c in coef], intercept, s["n"], s["rmse"], s["r2"]))
    df = spark.createDataFrame(rows, "reg_param double, elastic_net_param double, " + ", ".join(f"coef_{c} double" for c in ALL) + ", intercept double, n long, rmse double, r2 double")
    return df.select("reg_param", "elastic_net_param", *[_r(f"coef_{c}", R4) for c in ALL], _r("intercept", 2), "n", _r("rmse", R4), _r("r2", R8))


def q_ablation_all(spark, sf):
    """Linear fits without each feature, from one scan (M4)."""
    met = workflows.linear_ablations(spark, _frame(spark, sf), ALL, LABEL)
    return met.select("feature_set", "n_features", "n", _r("rmse", R4), _r("r2", R8), _r("rmse_change", R4), _r("rmse_change_pct", R4))


def q_linreg_random_tvs(spark, sf):
    """Linear grid tuned by the seeded random TrainValidationSplit."""
    train, test = _train_test(spark, sf)
    pipe = models.pipeline("linear", LIN1, LABEL)
    maps = _linear_grid(pipe.getStages()[-1])
    # The random split follows row placement, so that is fixed as for trees.
    train = models.canonical(train).persist()
    tvs = tuning.train_validation_split(pipe, maps, train, LABEL, seed=models.DEFAULT_SEED, parallelism=4)
    train.unpersist()
    best = tuning.grid_rows(maps)[tuning.best_index(tvs.validationMetrics)]
    return _holdout(tvs.bestModel.transform(test)).select(
        F.lit(best["regParam"]).alias("best_reg_param"), F.lit(best["elasticNetParam"]).alias("best_elastic_net_param"),
        "n", "rmse", "r2")


def family_run(spark, sf, family, *stages) -> workflows.FamilyRun:
    """Stages (baseline, cv, tvs; all by default) of a family on all six features."""
    return workflows.run_family(_frame(spark, sf), family, ALL, LABEL, stages=stages or None)


def _tuned(spark, sf, family, which):
    df = report.comparison(spark, family_run(spark, sf, family, which).runs)
    return df.select("model", "best_params", "best_max_depth", "best_max_iter", "best_num_trees", "n",
                     _r("rmse", R4), _r("r2", R8))


def q_tree_cv(spark, sf):
    """Tree tuned by CV, reference grid."""
    return _tuned(spark, sf, "tree", "cv")


def q_tree_tvs(spark, sf):
    """Tree tuned by train-validation."""
    return _tuned(spark, sf, "tree", "tvs")


def q_forest_cv(spark, sf):
    """Forest tuned by CV."""
    return _tuned(spark, sf, "forest", "cv")


def q_forest_tvs(spark, sf):
    """Forest tuned by train-validation."""
    return _tuned(spark, sf, "forest", "tvs")


def q_gbt_cv(spark, sf):
    """Boosted trees tuned by CV."""
    return _tuned(spark, sf, "gbt", "cv")


def q_gbt_tvs(spark, sf):
    """Boosted trees tuned by train-validation."""
    return _tuned(spark, sf, "gbt", "tvs")


# ---------------------------------------------------------------------------
# 8 reports


def q_metric_comparison(spark, sf):
    """Linear baseline / CV / TVS comparison with timings."""
    return report.comparison(spark, family_run(spark, sf, "linear").runs)


def q_best_params(spark, sf):
    """Boosted comparison with best hyper-parameters (O2)."""
    df = report.comparison(spark, family_run(spark, sf, "gbt").runs)
    return df.select("model", "rmse", "r2", "seconds", "elapsed", "best_max_depth", "best_max_iter")


def q_best_model(spark, sf):
    """Grid point with the lowest holdout RMSE (A4)."""
    t = _elastic_net_table(spark, sf)
    best = report.best_by(t, "rmse", ["reg_param", "elastic_net_param"])
    return best.select("reg_param", "elastic_net_param", _r("rmse", R4), _r("r2", R8))


def _ablation(spark, sf, family, feats):
    met = workflows.ablation_report(spark, _frame(spark, sf), family, feats, LABEL, [X1])
    return met.select("feature_set", "n_features", _r("rmse", R4), _r("r2", R8),
                      _r("rmse_change", R4), _r("rmse_change_pct", R4))


def q_ablation(spark, sf):
    """Linear model with and without the list price (closed-form oracle)."""
    return _ablation(spark, sf, "linear", LIN2)


def q_stage_status(spark, sf):
    """Stage completion table."""
    return report.stage_status(report.comparison(spark, family_run(spark, sf, "linear").runs))


def q_elapsed_format(spark, sf):
    """Mean order-to-shipment time per order, formatted H:MM:SS.

    lineitem is pre-aggregated per order (sum of ship times, line count)
    before the join, so a hot order collapses map-side and the join is 1:1
    on the order key."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # Epoch seconds are ~1e9 each: a hot order's sum would overflow a long,
    # so it is summed as an exact decimal.
    dec = "decimal(38,0)"
    per_order = tables.load(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.timestamp_diff("SECOND", epoch, F.col("l_shipdate")).cast(dec)).alias("ship_s"),
        F.count(F.lit(1)).alias("lines"))
    od = tables.load(spark, sf, "orders").select(
        "o_orderkey", F.timestamp_diff("SECOND", epoch, F.col("o_orderdate")).alias("order_s"))
    # Order-level fact join, 1:1 on the key: pinned to a sort-merge join;
    # the aggregate side is already partitioned by the key.
    lag = per_order.hint("merge").join(od, per_order.l_orderkey == od.o_orderkey).select(
        "o_orderkey",
        ((F.col("ship_s") - F.col("lines").cast(dec) * F.col("order_s").cast(dec)).cast("double")
         / F.col("lines")).alias("seconds"))
    return lag.select("o_orderkey", _r("seconds", 3), elapsed_hms("seconds").alias("elapsed"))


def q_market_day(spark, sf):
    """Market table, nation x day (the benchmark grain)."""
    return mk.build_market(spark, sf, "day")


def q_linreg_cv_candidates(spark, sf):
    """Per-candidate mean and spread of fold RMSE."""
    cv, maps, _, _ = _linreg_cv(spark, sf)
    cand = tuning.candidate_table(spark, cv, maps)
    g = F.element_at(_grid_array(maps), F.col("point") + 1)
    return cand.select(g["reg_param"].alias("reg_param"), g["elastic_net_param"].alias("elastic_net_param"),
                       _r("avg_rmse", R4), _r("std_rmse", R4), "is_best")


def q_gbt_ablation(spark, sf):
    """The reference's ablation on the boosted model: drop the dominant
    feature, keep every other setting (iterations included) fixed."""
    return _ablation(spark, sf, "gbt", ALL)


def q_linreg_importance(spark, sf):
    """Coefficients of the all-feature linear model ranked by |coefficient|
    (the reference's linear 'importance'), with the scale-free
    coefficient x stddev beside it."""
    train, _ = _train_test(spark, sf)
    model = models.fit(train, "linear", ALL, LABEL)
    c = models.coefficients(spark, model, ALL, models.feature_stddevs(train, ALL))
    return c.where(F.col("term") != "intercept").orderBy(F.desc("abs_coefficient"))


def q_market_approx(spark, sf):
    """Market build with percentile_approx medians (scale option;
    no exact oracle)."""
    return mk.build_market(spark, sf, "month", exact=False)


def q_summary_approx(spark, sf):
    """describe + percentile_approx quartiles in one pass (G4 scale option)."""
    s = profile.summary(_market(spark, sf), MODEL_COLS, exact=False)
    return s.select("column_name", "count", _r("mean", R4), _r("stddev", R4), "min",
                    "p25", "p50", "p75", "max")


def q_summary_by_level(spark, sf):
    """Exact quartiles of the label per region granularity (G4 over S6):
    grouped quantiles at p = 0.25, 0.5, 0.75."""
    # Written once: the counts and the quantiles both read it.
    levels = materialize(mk.build_market_levels(spark, sf, "month"), "market-levels")
    q = exact_quantiles(levels, ["region_level"], [LABEL], (0.25, 0.5, 0.75))
    n = levels.groupBy("region_level").agg(F.count(F.lit(1)).alias("n"))
    return n.join(q, "region_level").select(
        "region_level", "n", *[_r(f"{LABEL}_p{p}", R4) for p in (25, 50, 75)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

# ---------------------------------------------------------------------------
# SQL oracles (DuckDB)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


MARKET = f"market AS ({mk.market_sql()})"
FRAME = """frame AS (
  SELECT *,
    CASE WHEN ((row_key * 2654435761) % 1000003) % 100 < 80 THEN 'train' ELSE 'test' END AS split,
    CAST(((row_key * 2246822519) % 1000003) % 3 AS INTEGER) AS fold,
    ((row_key * 2246822519) % 1000003) % 100 >= 80 AS is_validation
  FROM (SELECT *, CAST(region_id AS BIGINT) * 100000
                  + date_diff('day', DATE '1970-01-01', period_begin) AS row_key
        FROM market) k)"""
TRAIN = "train AS (SELECT * FROM frame WHERE split = 'train')"
TEST = "test AS (SELECT * FROM frame WHERE split = 'test')"
BASE = [MARKET, FRAME, TRAIN, TEST]

DIRTY = """dirty AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_linenumber WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN '1.2.3'
      WHEN 4 THEN '-' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 5 THEN '.'
      ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS qty_text,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.'
      || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS price_text,
    nullif(l_discount, 0.0) AS discount,
    CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS tax
  FROM lineitem)"""
DIRTY_NUM = """dnum AS (
  SELECT l_orderkey, l_linenumber, TRY_CAST(qty_text AS DOUBLE) AS quantity,
         TRY_CAST(price_text AS DOUBLE) AS price, discount, tax FROM dirty)"""


def _ok(c):
    return f"({c} IS NOT NULL AND NOT isnan({c}))"


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _grid_values():
    vals = []
    i = 0
    for reg in LINEAR_GRID["regParam"]:
        for a in LINEAR_GRID["elasticNetParam"]:
            vals.append(f"({i}, CAST({reg} AS DOUBLE), CAST({a} AS DOUBLE))")
            i += 1
    return f"grid AS (SELECT * FROM (VALUES {', '.join(vals)}) g(point, reg_param, elastic_net_param))"


GRID = _grid_values()

# One-feature elastic net with standardisation, in closed form:
# slope = sign(r) * max(|r| - e*a, 0) / (1 + e*(1-a)) * sy/sx, e = reg/sy.
_SLOPE = ("sign(r) * greatest(abs(r) - (reg_param / sy) * elastic_net_param, 0) "
          "/ (1 + (reg_param / sy) * (1 - elastic_net_param)) * sy / sx")
_STATS = ("corr(median_list_price, median_sale_price) AS r, stddev_pop(median_list_price) AS sx, "
          "stddev_pop(median_sale_price) AS sy, avg(median_list_price) AS mx, avg(median_sale_price) AS my")


def _metrics_sql(pred_from: str, group: str = "") -> str:
    sel = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"SELECT {sel}count(*) AS n, round(sqrt(avg(power(y - p, 2))), 4) AS rmse, "
            f"round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 8) AS r2, "
            f"round(avg(abs(y - p)), 4) AS mae FROM {pred_from}{gb}")


def _describe_part(c):
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, count({x}) AS count, round(avg({x}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS stddev, min({x}) AS min, max({x}) AS max FROM market")


def _summary_part(c):
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, count({x}) AS count, round(avg({x}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS stddev, min({x}) AS min, "
            f"round(quantile_cont({x}, 0.25), 4) AS p25, round(quantile_cont({x}, 0.5), 4) AS p50, "
            f"round(quantile_cont({x}, 0.75), 4) AS p75, max({x}) AS max FROM market")


def _corr_parts():
    out = []
    for i, a in enumerate(MODEL_COLS):
        for b in MODEL_COLS[i:]:
            out.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                       f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8) AS corr FROM market")
    return out


_COEF1 = _with(*BASE, f"s AS (SELECT regr_slope(median_sale_price, median_list_price) AS b, "
                      f"regr_intercept(median_sale_price, median_list_price) AS a, "
                      f"stddev_pop(median_list_price) AS sx FROM train)") + """
SELECT 'intercept' AS term, round(a, 4) AS coefficient, round(abs(a), 4) AS abs_coefficient,
       CAST(NULL AS DOUBLE) AS std_coefficient FROM s
UNION ALL
SELECT 'median_list_price', round(b, 4), round(abs(b), 4), round(b * sx, 4) FROM s"""

_CRAMER = """s AS (SELECT covar_pop(median_list_price, median_sale_price) AS c1y,
    covar_pop(homes_sold, median_sale_price) AS c2y, var_pop(median_list_price) AS v1,
    var_pop(homes_sold) AS v2, covar_pop(median_list_price, homes_sold) AS c12,
    avg(median_list_price) AS m1, avg(homes_sold) AS m2, avg(median_sale_price) AS my,
    stddev_pop(median_list_price) AS sd1, stddev_pop(homes_sold) AS sd2 FROM train),
f AS (SELECT *, (c1y * v2 - c2y * c12) / (v1 * v2 - c12 * c12) AS b1,
    (c2y * v1 - c1y * c12) / (v1 * v2 - c12 * c12) AS b2 FROM s),
f2 AS (SELECT *, my - b1 * m1 - b2 * m2 AS a FROM f)"""

_COEF2 = _with(*BASE, _CRAMER) + """
SELECT 'intercept' AS term, round(a, 4) AS coefficient, round(abs(a), 4) AS abs_coefficient,
       CAST(NULL AS DOUBLE) AS std_coefficient FROM f2
UNION ALL SELECT 'median_list_price', round(b1, 4), round(abs(b1), 4), round(b1 * sd1, 4) FROM f2
UNION ALL SELECT 'homes_sold', round(b2, 4), round(abs(b2), 4), round(b2 * sd2, 4) FROM f2"""

_FIT1 = ("fit1 AS (SELECT regr_slope(median_sale_price, median_list_price) AS b, "
         "regr_intercept(median_sale_price, median_list_price) AS a FROM train)")
_PRED1 = ("pred AS (SELECT t.region_id, t.period_begin, t.median_sale_price AS y, "
          "f.b * t.median_list_price + f.a AS p FROM test t, fit1 f)")

_ENET = [
    GRID,
    f"st AS (SELECT {_STATS} FROM train)",
    f"fit AS (SELECT g.*, {_SLOPE} AS slope, mx, my FROM grid g, st)",
    "fit2 AS (SELECT *, my - slope * mx AS intercept FROM fit)",
    """enet AS (SELECT f.point, f.reg_param, f.elastic_net_param, f.slope, f.intercept,
        sqrt(avg(power(t.median_sale_price - (f.slope * t.median_list_price + f.intercept), 2))) AS rmse,
        1 - sum(power(t.median_sale_price - (f.slope * t.median_list_price + f.intercept), 2))
          / (var_pop(t.median_sale_price) * count(*)) AS r2
      FROM fit2 f, test t GROUP BY f.point, f.reg_param, f.elastic_net_param, f.slope, f.intercept)""",
]

_CV = [
    GRID,
    "folds AS (SELECT * FROM (VALUES (0), (1), (2)) v(fold))",
    f"fst AS (SELECT f.fold, {_STATS.replace('median_', 't.median_')} "
    "FROM folds f JOIN train t ON t.fold <> f.fold GROUP BY f.fold)",
    f"ffit AS (SELECT g.*, s.fold, {_SLOPE} AS slope, mx, my FROM grid g, fst s)",
    "ffit2 AS (SELECT *, my - slope * mx AS intercept FROM ffit)",
    """fold_rmse AS (SELECT p.point, p.reg_param, p.elastic_net_param, p.fold, count(*) AS n,
        sqrt(avg(power(t.median_sale_price - (p.slope * t.median_list_price + p.intercept), 2))) AS rmse
      FROM ffit2 p JOIN train t ON t.fold = p.fold
      GROUP BY p.point, p.reg_param, p.elastic_net_param, p.fold)""",
    """cv AS (SELECT point, reg_param, elastic_net_param, avg(rmse) AS cv_rmse FROM fold_rmse
      GROUP BY point, reg_param, elastic_net_param)""",
    "best AS (SELECT * FROM cv ORDER BY cv_rmse, point LIMIT 1)",
    f"st AS (SELECT {_STATS} FROM train)",
    f"bfit AS (SELECT b.*, {_SLOPE} AS slope, mx, my FROM best b, st)",
    "bfit2 AS (SELECT *, my - slope * mx AS intercept FROM bfit)",
    """pred AS (SELECT t.median_sale_price AS y, b.slope * t.median_list_price + b.intercept AS p
      FROM test t, bfit2 b)""",
]

_TVS = [
    GRID,
    f"vst AS (SELECT {_STATS} FROM train WHERE NOT is_validation)",
    f"vfit AS (SELECT g.*, {_SLOPE} AS slope, mx, my FROM grid g, vst)",
    "vfit2 AS (SELECT *, my - slope * mx AS intercept FROM vfit)",
    """vscore AS (SELECT p.point, p.reg_param, p.elastic_net_param,
        sqrt(avg(power(t.median_sale_price - (p.slope * t.median_list_price + p.intercept), 2))) AS vrmse
      FROM vfit2 p, train t WHERE t.is_validation GROUP BY p.point, p.reg_param, p.elastic_net_param)""",
    "best AS (SELECT * FROM vscore ORDER BY vrmse, point LIMIT 1)",
    f"st AS (SELECT {_STATS} FROM train)",
    f"bfit AS (SELECT b.*, {_SLOPE} AS slope, mx, my FROM best b, st)",
    "bfit2 AS (SELECT *, my - slope * mx AS intercept FROM bfit)",
    """pred AS (SELECT t.median_sale_price AS y, b.slope * t.median_list_price + b.intercept AS p
      FROM test t, bfit2 b)""",
]

STEPPED = """stepped AS MATERIALIZED (
  SELECT row_key AS rid, split, fold, is_validation, median_sale_price AS y,
    greatest(0.0, least(30.0, CAST(floor(median_list_price / 15000) AS DOUBLE))) AS f0,
    greatest(0.0, least(30.0, CAST(floor(median_ppsf / 250) AS DOUBLE))) AS f1
  FROM frame)"""


def _grow(t: str, rows: str, depth: int) -> list[str]:
    """CTEs of greedy regression trees over ``rows`` (run, rid, fit, f0, f1, y), one tree
    for each run, grown on its rows with ``fit``: ``{t}_s{d}`` has the splits of
    level d with their gains, ``{t}_p{d}`` every row's prediction at depth d.

    A split lies midway between a value that the node holds and the next value of
    all rows that are fitted; the gain is the fall of the squared error."""
    both = lambda sql: _union([sql.format(f=f) for f in (0, 1)])
    out = [
        f"{t}_v AS MATERIALIZED (SELECT run, f, x, lead(x) OVER (PARTITION BY run, f ORDER BY x) AS nx FROM ("
        + both(f"SELECT DISTINCT run, {{f}} AS f, f{{f}} AS x FROM {rows} WHERE fit") + ") q)",
        f"{t}_n0 AS MATERIALIZED (SELECT run, rid, fit, f0, f1, y, 1 AS node FROM {rows})",
    ]
    for d in range(depth + 1):
        out.append(f"{t}_p{d} AS MATERIALIZED (SELECT n.run, n.rid, n.fit, n.y, l.p FROM {t}_n{d} n JOIN "
                   f"(SELECT run, node, avg(y) AS p FROM {t}_n{d} WHERE fit GROUP BY run, node) l USING (run, node))")
        if d == depth:
            break
        bins = both(f"SELECT run, node, {{f}} AS f, f{{f}} AS x, count(*) AS c, sum(y) AS s FROM {t}_n{d} WHERE fit GROUP BY run, node, f{{f}}")
        out += [
            f"{t}_w{d} AS MATERIALIZED (SELECT run, node, f, x, sum(c) OVER a AS nl, sum(s) OVER a AS sl, sum(c) OVER b AS n, sum(s) OVER b AS st "
            f"FROM ({bins}) q WINDOW a AS (PARTITION BY run, node, f ORDER BY x), b AS (PARTITION BY run, node, f))",
            f"{t}_s{d} AS MATERIALIZED (SELECT run, node, f, (x + nx) / 2 AS thr, "
            f"sl * sl / nl + (st - sl) * (st - sl) / (n - nl) - st * st / n AS gain FROM {t}_w{d} JOIN {t}_v USING (run, f, x) "
            "WHERE nl < n QUALIFY row_number() OVER (PARTITION BY run, node ORDER BY gain DESC, f, thr) = 1)",
            f"{t}_n{d + 1} AS MATERIALIZED (SELECT n.run, n.rid, n.fit, n.f0, n.f1, n.y, CASE WHEN s.gain > 0 THEN 2 * n.node "
            f"+ CAST(CASE s.f WHEN 0 THEN n.f0 ELSE n.f1 END > s.thr AS INT) ELSE n.node END AS node "
            f"FROM {t}_n{d} n LEFT JOIN {t}_s{d} s USING (run, node))",
        ]
    return out


SWEEPS = 400


def _descent(runs: str, fits: str) -> list[str]:
    """CTEs of linear fits by coordinate descent on correlations: ``runs`` selects (run, use, reg, alpha), where ``use`` has a 1 for
    every feature that takes part; ``fits`` names the table that holds (run, the features, y) of the fitted rows.  ``line`` has every run's
    coefficients ``b`` and its intercept."""
    k = len(ALL)
    rows = [f"[{', '.join(f'CASE WHEN use[{i + 1}] * use[{j + 1}] = 0 THEN {float(i == j)} ELSE c{min(i, j)}_{max(i, j)} / (s{i} * s{j}) END' for j in range(k))}]" for i in range(k)]
    stats = ", ".join([f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}, covar_pop({c}, y) AS y{i}" for i, c in enumerate(ALL)]
                      + [f"covar_pop({ALL[i]}, {ALL[j]}) AS c{i}_{j}" for i in range(k) for j in range(i, k)])
    z = "(g.cy[j] - list_dot_product(g.m[j], b) + b[j])"
    return [
        f"runs AS MATERIALIZED ({runs})",
        f"st AS MATERIALIZED (SELECT run, avg(y) AS my, stddev_pop(y) AS sy, {stats} FROM {fits} GROUP BY run)",
        f"gram AS MATERIALIZED (SELECT run, use, reg / sy * alpha AS l1, reg / sy * (1 - alpha) AS l2, [{', '.join(rows)}] AS m, "
        f"[{', '.join(f'use[{i + 1}] * y{i} / (s{i} * sy)' for i in range(k))}] AS cy FROM runs JOIN st USING (run))",
        f"""steps AS (SELECT run, 0 AS step, [{', '.join(['CAST(0 AS DOUBLE)'] * k)}] AS b FROM runs
          UNION ALL SELECT run, step + 1, list_concat(list_concat(b[:j - 1], [use[j] * sign({z}) * greatest(abs({z}) - l1, 0) / (1 + l2)]), b[j + 1:])
          FROM (SELECT *, step % {k} + 1 AS j FROM steps) s JOIN gram g USING (run) WHERE step < {SWEEPS * k})""",
        "scaled AS MATERIALIZED (SELECT run, " + ", ".join(f"b[{i + 1}] * sy / s{i} AS b{i}" for i in range(k)) + f" FROM steps JOIN st USING (run) WHERE step = {SWEEPS * k})",
        "line AS MATERIALIZED (SELECT run, " + ", ".join(f"b{i}" for i in range(k)) + ", my - " + " - ".join(f"b{i} * m{i}" for i in range(k)) + " AS a FROM scaled JOIN st USING (run))",
    ]


_LINE = " + ".join(["a", *[f"b{i} * t.{c}" for i, c in enumerate(ALL)]])
_ON = "[" + ", ".join(["1"] * len(ALL)) + "]"
_FEATS = ", ".join(ALL)


def _with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


#: Rows of the model frame with their quantile levels; the edges are of the training rows.
LEVEL_STEPS = ", ".join(str(k / binning.LEVELS) for k in range(1, binning.LEVELS))
BINNED = ["edges AS MATERIALIZED (SELECT " + ", ".join(f"list_distinct(quantile_cont({c}, [{LEVEL_STEPS}])) AS e{i}" for i, c in enumerate(ALL)) + " FROM train)",
          "binned AS MATERIALIZED (SELECT row_key AS rid, split = 'train' AS fit, median_sale_price AS y, "
          + ", ".join(f"len([e FOR e IN e{i} IF e <= {c}]) AS f{i}" for i, c in enumerate(ALL)) + " FROM frame, edges)"]
_LEVEL_COLS = ", ".join(f"f{i}" for i in range(len(ALL)))


def _grid_unit(largest: str, rows: str) -> str:
    return f"pow(2, ceil(log2({largest} * sqrt({rows})) - 26))"


def _on_grid(value: str, unit: str) -> str:
    return f"floor(({value}) / {unit} + 0.5) * {unit}"


def _cells(trees: list[str]) -> list[str]:
    """CTEs of the cells: levels with weights and mean labels (on the grid) of each tree's row weights, and
    every row that is not fitted as a cell of its own, of weight 0."""
    sums = ", ".join(f"CAST(sum({w}) AS DOUBLE) AS w{i}, CAST(sum({w} * k) AS DOUBLE) AS s{i}" for i, w in enumerate(trees))
    means = ", ".join(f"w{i}, CASE WHEN w{i} > 0 THEN {_on_grid(f's{i} * fine / w{i}', 'unit')} END AS y{i}" for i in range(len(trees)))
    none = ", ".join(f"0.0 AS w{i}, NULL AS y{i}" for i in range(len(trees)))
    return [
        "scale AS MATERIALIZED (SELECT *, " + _grid_unit("2 * (hi - lo)", "n") + " AS step, pow(2, ceil(log2(big * n)) - 60) AS fine, "
        + _grid_unit("big", "(2 * n)") + " AS unit FROM (SELECT count(*) AS n, min(y) AS lo, max(y) AS hi, max(abs(y)) AS big FROM binned WHERE fit) q)",
        f"sums AS MATERIALIZED (SELECT {_LEVEL_COLS}, {sums} FROM (SELECT *, CAST(floor(y / fine + 0.5) AS BIGINT) AS k FROM binned, scale WHERE fit) q GROUP BY {_LEVEL_COLS})",
        f"cells AS MATERIALIZED (SELECT -row_number() OVER () AS rid, true AS fit, NULL AS real, {_LEVEL_COLS}, {means} FROM sums, scale "
        f"UNION ALL SELECT rid, false, y, {_LEVEL_COLS}, {none} FROM binned WHERE NOT fit)",
    ]


def _cell_tree(t: str, rows: str, depth: int = 5, used=range(len(ALL))) -> list[str]:
    """CTEs of one regression tree over ``rows`` (rid, f0.., w, y): ``{t}_p`` has every row's prediction.  Gains are
    in the form and order of operations of variance impurity, on sums that doubles hold exactly."""
    both = lambda sql: _union([sql.format(f=f) for f in used])
    impurity = lambda n, s, q: f"(({q}) - ({s}) * ({s}) / ({n})) / ({n})"
    out = [f"{t}_v AS MATERIALIZED (SELECT f, x, lead(x) OVER (PARTITION BY f ORDER BY x) AS nx FROM ("
           + both(f"SELECT DISTINCT {{f}} AS f, f{{f}} AS x FROM {rows} WHERE w > 0") + ") q)"]
    place = f"(SELECT rid, w, y, {_LEVEL_COLS}, 1 AS node FROM {rows})"
    for d in range(depth):
        bins = both(f"SELECT node, {{f}} AS f, f{{f}} AS x, sum(w) AS c, sum(w * y) AS s, sum(w * y * y) AS q FROM {t}_n{d} WHERE w > 0 GROUP BY node, f{{f}}")
        gain = f"{impurity('n', 'st', 'qt')} - nl / n * {impurity('nl', 'sl', 'ql')} - (n - nl) / n * {impurity('n - nl', 'st - sl', 'qt - ql')}"
        out += [
            f"{t}_n{d} AS MATERIALIZED {place}",
            f"{t}_s{d} AS MATERIALIZED (SELECT node, f, (x + nx) / 2 AS thr, {gain} AS gain FROM (SELECT node, f, x, sum(c) OVER a AS nl, sum(s) OVER a AS sl, sum(q) OVER a AS ql, "
            f"sum(c) OVER b AS n, sum(s) OVER b AS st, sum(q) OVER b AS qt FROM ({bins}) q WINDOW a AS (PARTITION BY node, f ORDER BY x), b AS (PARTITION BY node, f)) q "
            f"JOIN {t}_v USING (f, x) WHERE nl < n QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, thr) = 1)",
        ]
        value = "CASE s.f " + " ".join(f"WHEN {f} THEN n.f{f}" for f in used) + " END"
        place = (f"(SELECT n.* REPLACE (CASE WHEN s.gain > 0 THEN 2 * n.node + CAST({value} > s.thr AS INT) ELSE n.node END AS node) "
                 f"FROM {t}_n{d} n LEFT JOIN {t}_s{d} s USING (node))")
    out += [f"{t}_n{depth} AS MATERIALIZED {place}",
            f"{t}_p AS MATERIALIZED (SELECT rid, p FROM {t}_n{depth} JOIN (SELECT node, sum(w * y) / sum(w) AS p FROM {t}_n{depth} WHERE w > 0 GROUP BY node) l USING (node))"]
    return out


def _bag_weight(tree: int, seed: int) -> str:
    draw = f"(CAST('0x' || substr(md5('{seed}:{tree}:' || rid), 1, 8) AS UBIGINT) / 4294967296.0)"
    return "(" + " + ".join(f"CAST({draw} >= {step!r} AS INT)" for step in ensembles.poisson_steps()) + ")"


def _boosted(trees: int) -> list[str]:
    """CTEs of boosted trees on the cells: ``pred`` has the holdout's predictions."""
    out = [*_cells(["1"]), f"b0 AS MATERIALIZED (SELECT rid, w0 AS w, y0 AS y, {_LEVEL_COLS}, 0.0 AS so_far, y0, real FROM cells)"]
    for i in range(trees):
        step = "" if i == 0 else "0.1 * "
        so_far = f"b.so_far + {step}p.p"
        label = _on_grid(f"2 * (b.y0 - ({so_far}))", "step")
        out += _cell_tree(f"t{i}", f"b{i}")
        out.append(f"b{i + 1} AS MATERIALIZED (SELECT b.* REPLACE ({so_far} AS so_far, {label} AS y) FROM b{i} b JOIN t{i}_p p USING (rid), scale)")
    return [*out, f"pred AS (SELECT real AS y, so_far AS p FROM b{trees} WHERE real IS NOT NULL)"]


_THREE = [*_cells([_bag_weight(i, models.DEFAULT_SEED) for i in range(3)]),
          *[cte for i in range(3) for cte in (
              f"r{i} AS MATERIALIZED (SELECT rid, w{i} AS w, y{i} AS y, {_LEVEL_COLS} FROM cells)",
              *_cell_tree(f"t{i}", f"r{i}", used=ensembles.tree_features(len(ALL), i, THREE_TREES["featureShare"], models.DEFAULT_SEED)))],
          "pred AS (SELECT real AS y, (t0_p.p + t1_p.p + t2_p.p) / 3 AS p FROM cells JOIN t0_p USING (rid) JOIN t1_p USING (rid) JOIN t2_p USING (rid) WHERE real IS NOT NULL)"]


ONE = "one AS MATERIALIZED (SELECT 0 AS run, rid, split = 'train' AS fit, f0, f1, y FROM stepped)"
_ONE_TREE = [ONE, *_grow("t", "one", 3)]


def _depth_sql(runs: str) -> str:
    """The depth with the lowest mean RMSE over the runs' rows that are not fitted,
    and the holdout metrics of the tree of that depth."""
    score = _union([f"SELECT {d} AS depth, run, sqrt(avg(power(y - p, 2))) AS rmse FROM c_p{d} WHERE NOT fit GROUP BY run" for d in DEPTHS])
    final = _union([f"SELECT {d} AS depth, y, p FROM t_p{d} WHERE NOT fit" for d in DEPTHS])
    return _with(*BASE, STEPPED, f"runs AS MATERIALIZED ({runs})", *_grow("c", "runs", 3), *_ONE_TREE,
                 f"scores AS (SELECT depth, avg(rmse) AS rmse FROM ({score}) q GROUP BY depth)",
                 "best AS MATERIALIZED (SELECT depth, rmse FROM scores ORDER BY rmse, depth LIMIT 1)",
                 f"pred AS (SELECT y, p FROM ({final}) q JOIN best USING (depth))") + """
SELECT b.depth AS best_max_depth, round(b.rmse, 4) AS tuning_rmse, m.n, m.rmse, m.r2
FROM best b, (""" + _metrics_sql("pred") + ") m"


_STUMP = [
    "g AS (SELECT f0 AS x, count(*) AS c, sum(y) AS s FROM stepped WHERE split = 'train' GROUP BY 1)",
    """w AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(c) OVER (ORDER BY x) AS nl,
        sum(s) OVER (ORDER BY x) AS sl FROM g)""",
    "tot AS (SELECT count(*) AS n, sum(median_sale_price) AS sy FROM train)",
    """cand AS (SELECT (x + nx) / 2.0 AS thr, nl, sl, n - nl AS nr, sy - sl AS sr FROM w, tot
      WHERE nx IS NOT NULL)""",
]

ORACLE_SQL: dict[str, str] = {
    "market_base": mk.market_sql(),
    "market_day": mk.market_sql("day"),
    "scan_select": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
    "csv_roundtrip": mk.market_sql(),
    "sql_view": mk.market_sql(),
    "schema_table": _with(MARKET) + _union([
        f"SELECT '{f.name}' AS column_name, '{profile.sql_type(f.dataType)}' AS data_type, "
        f"count({f.name}) AS non_null FROM market"
        for f in MARKET_SCHEMA.fields
    ]),
    "union_levels": _union([
        f"SELECT '{lv}' AS region_level, * FROM ({mk.market_sql('month', lv)}) m{i}"
        for i, lv in enumerate(mk.LEVELS)
    ]),
    "clean_regex_cast": _with(DIRTY) + """
SELECT l_orderkey, l_linenumber, qty_text,
  CASE WHEN regexp_matches(qty_text, '^[0-9.]+$') THEN TRY_CAST(qty_text AS DOUBLE) END AS quantity,
  CASE WHEN regexp_matches(price_text, '^[0-9.]+$') THEN TRY_CAST(price_text AS DOUBLE) END AS price
FROM dirty""",
    "clean_try_cast": _with(DIRTY) + """
SELECT l_orderkey, l_linenumber, qty_text, TRY_CAST(qty_text AS DOUBLE) AS quantity,
  TRY_CAST(price_text AS DOUBLE) AS price FROM dirty""",
    "drop_null_any": _with(DIRTY, DIRTY_NUM) + f"""
SELECT * FROM dnum WHERE {_ok('quantity')} AND {_ok('price')} AND {_ok('discount')} AND {_ok('tax')}""",
    "drop_null_subset": _with(DIRTY, DIRTY_NUM) + f"""
SELECT * FROM dnum WHERE {_ok('quantity')} AND {_ok('tax')}""",
    "impute_mean": _with(DIRTY, DIRTY_NUM, f"kept AS (SELECT * FROM dnum WHERE {_ok('price')})",
                         """m AS (SELECT avg(quantity) FILTER (WHERE NOT isnan(quantity)) AS mq,
    avg(discount) FILTER (WHERE NOT isnan(discount)) AS md,
    avg(tax) FILTER (WHERE NOT isnan(tax)) AS mt FROM kept)""") + """
SELECT l_orderkey, l_linenumber, price,
  round(coalesce(CASE WHEN isnan(quantity) THEN NULL ELSE quantity END, mq), 8) AS quantity,
  round(coalesce(CASE WHEN isnan(discount) THEN NULL ELSE discount END, md), 8) AS discount,
  round(coalesce(CASE WHEN isnan(tax) THEN NULL ELSE tax END, mt), 8) AS tax
FROM kept, m""",
    "row_count": _with(MARKET) + "SELECT count(*) AS n FROM market",
    "null_profile": _with(DIRTY, DIRTY_NUM) + """
SELECT count(*) FILTER (WHERE quantity IS NULL) AS quantity, count(*) FILTER (WHERE price IS NULL) AS price,
  count(*) FILTER (WHERE discount IS NULL) AS discount, count(*) FILTER (WHERE tax IS NULL) AS tax
FROM dnum""",
    "describe": _with(MARKET) + _union([_describe_part(c) for c in MODEL_COLS]),
    "summary_quartiles": _with(MARKET) + _union([_summary_part(c) for c in MODEL_COLS]),
    "correlation_matrix": _with(MARKET) + _union(_corr_parts()),
    "series_head": _with(MARKET) + """
SELECT period_begin, region_id, median_sale_price FROM market ORDER BY period_begin, region_id LIMIT 10""",
    "hash_split_counts": _with(MARKET, FRAME) + "SELECT split, count(*) AS n FROM frame GROUP BY split",
    "fold_counts": _with(MARKET, FRAME) + "SELECT fold, count(*) AS n FROM frame GROUP BY fold",
    "assemble_vector": _with(MARKET) + _union([
        f"SELECT region_id, period_begin, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM market"
        for c in ALL
    ]),
    "linreg_1f_coef": _COEF1,
    "linreg_2f_coef": _COEF2,
    "linreg_holdout_metrics": _with(*BASE, _FIT1, _PRED1) + _metrics_sql("pred"),
    "linreg_predictions": _with(*BASE, _FIT1, _PRED1) + """
SELECT region_id, period_begin, y AS median_sale_price, round(p, 4) AS prediction FROM pred""",
    "elastic_net_metrics": _with(*BASE, *_ENET) + """
SELECT reg_param, elastic_net_param, round(slope, 8) AS slope, round(intercept, 4) AS intercept,
  round(rmse, 4) AS rmse, round(r2, 8) AS r2 FROM enet""",
    "tree_stump": _with(*BASE, STEPPED, *_STUMP) + """
SELECT 'price_step' AS feature, round(thr, 4) AS threshold, round(sl / nl, 4) AS left_mean,
  round(sr / nr, 4) AS right_mean, CAST(nl AS BIGINT) AS n_left, CAST(nr AS BIGINT) AS n_right
FROM cand ORDER BY sl * sl / nl + sr * sr / nr DESC, thr LIMIT 1""",
    "tree_exact_metrics": _with(*BASE, STEPPED, *_ONE_TREE) + _metrics_sql("(SELECT * FROM t_p3 WHERE NOT fit)"),
    "forest_one_tree": _with(*BASE, STEPPED, *_ONE_TREE) + _metrics_sql("(SELECT * FROM t_p3 WHERE NOT fit)"),
    "tree_exact_importance": _with(*BASE, STEPPED, *_ONE_TREE,
                                   "gains AS (" + _union([f"SELECT f, gain FROM t_s{d} WHERE gain > 0" for d in range(3)]) + ")",
                                   "names AS (SELECT * FROM (VALUES (0, 'price_step'), (1, 'ppsf_step')) v(f, feature))",
                                   "imp AS (SELECT feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains) AS v "
                                   "FROM names LEFT JOIN gains USING (f) GROUP BY feature)") + """
SELECT feature, round(v, 8) AS importance, CAST(row_number() OVER (ORDER BY v DESC, feature) AS INT) AS rank FROM imp""",
    "tree_d5_metrics": _with(*BASE, *BINNED, *_boosted(1)) + _metrics_sql("pred"),
    "gbt_metrics": _with(*BASE, *BINNED, *_boosted(20)) + _metrics_sql("pred"),
    "forest_three_trees": _with(*BASE, *BINNED, *_THREE) + _metrics_sql("pred"),
    "elastic_net_all_features": _with_recursive(
        *BASE, GRID, f"fits AS (SELECT point AS run, {_FEATS}, median_sale_price AS y FROM train, grid)",
        *_descent(f"SELECT point AS run, {_ON} AS use, reg_param AS reg, elastic_net_param AS alpha FROM grid", "fits"),
        f"pred AS (SELECT run, t.median_sale_price AS y, {_LINE} AS p FROM test t, line)",
        "met AS (" + _metrics_sql("pred", "run") + ")") + "SELECT reg_param, elastic_net_param, "
        + ", ".join(f"round(b{i}, 4) AS coef_{c}" for i, c in enumerate(ALL)) + ", round(a, 2) AS intercept, n, rmse, r2 FROM grid JOIN line ON run = point JOIN met USING (run)",
    "linreg_cv_all_features": _with_recursive(
        *BASE, GRID, f"fits AS (SELECT g.point * 3 + v.fold AS run, {_FEATS}, median_sale_price AS y FROM train t, grid g, (VALUES (0), (1), (2)) v(fold) WHERE t.fold <> v.fold)",
        *_descent(f"SELECT g.point * 3 + v.fold AS run, {_ON} AS use, reg_param AS reg, elastic_net_param AS alpha FROM grid g, (VALUES (0), (1), (2)) v(fold)", "fits"),
        f"pred AS (SELECT run, t.median_sale_price AS y, {_LINE} AS p FROM train t JOIN line ON run % 3 = t.fold)",
        "met AS (" + _metrics_sql("pred", "run") + ")") + "SELECT reg_param, elastic_net_param, CAST(run % 3 AS INT) AS fold, n, rmse FROM met JOIN grid ON point = run // 3",
    "ablation_all": _with_recursive(
        *BASE, "sets AS (SELECT * FROM (VALUES " + ", ".join(
            f"({r}, '{'all' if not r else 'without_' + ALL[r - 1]}', [{', '.join('0' if i == r - 1 else '1' for i in range(len(ALL)))}])" for r in range(len(ALL) + 1)) + ") v(run, feature_set, use))",
        f"fits AS (SELECT run, {_FEATS}, median_sale_price AS y FROM train, sets)",
        *_descent("SELECT run, use, 0.0 AS reg, 0.0 AS alpha FROM sets", "fits"),
        f"pred AS (SELECT run, t.median_sale_price AS y, {_LINE} AS p FROM test t, line)",
        "met AS (SELECT run, count(*) AS n, sqrt(avg(power(y - p, 2))) AS rmse, 1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM pred GROUP BY run)",
        "whole AS (SELECT rmse AS full_rmse FROM met WHERE run = 0)") + """
SELECT feature_set, CAST(list_sum(use) AS INT) AS n_features, n, round(rmse, 4) AS rmse, round(r2, 8) AS r2,
  round(rmse - full_rmse, 4) AS rmse_change, round((rmse - full_rmse) / full_rmse * 100, 4) AS rmse_change_pct
FROM met JOIN sets USING (run), whole""",
    "gbt_two_iterations": _with(*BASE, STEPPED, ONE, *_grow("a", "one", 2),
                                "rest AS MATERIALIZED (SELECT o.run, o.rid, o.fit, o.f0, o.f1, 2 * (o.y - a_p2.p) AS y "
                                "FROM one o JOIN a_p2 USING (run, rid))",
                                *_grow("b", "rest", 2),
                                "pred AS (SELECT o.y, a_p2.p + 0.1 * b_p2.p AS p FROM one o JOIN a_p2 USING (run, rid) "
                                "JOIN b_p2 USING (run, rid) WHERE NOT o.fit)") + _metrics_sql("pred"),
    "tree_exact_cv": _depth_sql("SELECT v.run, s.split = 'train' AND s.fold <> v.run AS fit, s.* FROM stepped s, "
                                "(VALUES (0), (1), (2)) v(run) WHERE s.split = 'train'"),
    "tree_exact_tvs": _depth_sql("SELECT 0 AS run, NOT is_validation AS fit, * FROM stepped WHERE split = 'train'"),
    "linreg_imputed": _with(DIRTY, DIRTY_NUM, f"""kept AS (SELECT price,
    CASE WHEN isnan(quantity) THEN NULL ELSE quantity END AS q,
    (((l_orderkey * 8 + l_linenumber) * 2654435761) % 1000003) % 100 < 80 AS fit FROM dnum WHERE {_ok('price')})""",
                            "m AS (SELECT avg(q) AS mq FROM kept WHERE fit)",
                            "filled AS (SELECT price AS y, coalesce(q, mq) AS x, fit FROM kept, m)",
                            "line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM filled WHERE fit)",
                            "pred AS (SELECT y, b * x + a AS p FROM filled, line WHERE NOT fit)") + _metrics_sql("pred"),
    "param_grid": _with(*BASE, GRID, "fc AS (SELECT fold, count(*) AS n_eval FROM train GROUP BY fold)",
                        "tot AS (SELECT sum(n_eval) AS n FROM fc)") + """
SELECT g.point, g.reg_param, g.elastic_net_param, fc.fold, CAST(tot.n - fc.n_eval AS BIGINT) AS n_fit,
  fc.n_eval
FROM grid g, fc, tot""",
    "linreg_cv": _with(*BASE, *_CV) + """
SELECT b.reg_param AS best_reg_param, b.elastic_net_param AS best_elastic_net_param,
  round(b.cv_rmse, 4) AS cv_rmse, m.n, m.rmse, m.r2
FROM best b, (""" + _metrics_sql("pred") + ") m",
    "linreg_tvs": _with(*BASE, *_TVS) + """
SELECT b.reg_param AS best_reg_param, b.elastic_net_param AS best_elastic_net_param,
  round(b.vrmse, 4) AS validation_rmse, m.n, m.rmse, m.r2
FROM best b, (""" + _metrics_sql("pred") + ") m",
    "linreg_cv_fold_rmse": _with(*BASE, *_CV) + """
SELECT reg_param, elastic_net_param, fold, n, round(rmse, 4) AS rmse FROM fold_rmse""",
    "summary_by_level": _with("levels AS (" + _union([
        f"SELECT '{lv}' AS region_level, * FROM ({mk.market_sql('month', lv)}) m{i}"
        for i, lv in enumerate(mk.LEVELS)]) + ")") + """
SELECT region_level, count(*) AS n,
  round(quantile_cont(median_sale_price, 0.25), 4) AS median_sale_price_p25,
  round(quantile_cont(median_sale_price, 0.5), 4) AS median_sale_price_p50,
  round(quantile_cont(median_sale_price, 0.75), 4) AS median_sale_price_p75
FROM levels GROUP BY region_level""",
    "linreg_cv_candidates": _with(*BASE, *_CV) + """
SELECT reg_param, elastic_net_param, round(cv_rmse, 4) AS avg_rmse, round(sd, 4) AS std_rmse,
  point = (SELECT point FROM best) AS is_best
FROM cv JOIN (SELECT point, stddev_pop(rmse) AS sd FROM fold_rmse GROUP BY point) s USING (point)""",
    "best_model": _with(*BASE, *_ENET) + """
SELECT reg_param, elastic_net_param, round(rmse, 4) AS rmse, round(r2, 8) AS r2
FROM enet ORDER BY rmse, reg_param, elastic_net_param LIMIT 1""",
    "ablation": _with(*BASE, _CRAMER, """pred AS (
  SELECT 'all' AS feature_set, 2 AS n_features, t.median_sale_price AS y,
         f.b1 * t.median_list_price + f.b2 * t.homes_sold + f.a AS p FROM test t, f2 f
  UNION ALL
  SELECT 'without_median_list_price', 1, t.median_sale_price,
         o.b * t.homes_sold + o.a FROM test t,
         (SELECT regr_slope(median_sale_price, homes_sold) AS b,
                 regr_intercept(median_sale_price, homes_sold) AS a FROM train) o)""",
                      """met AS (SELECT feature_set, n_features, sqrt(avg(power(y - p, 2))) AS rmse,
    1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)) AS r2 FROM pred GROUP BY feature_set, n_features)""") + """
SELECT feature_set, n_features, round(rmse, 4) AS rmse, round(r2, 8) AS r2,
  round(rmse - (SELECT rmse FROM met WHERE feature_set = 'all'), 4) AS rmse_change,
  round((rmse - (SELECT rmse FROM met WHERE feature_set = 'all'))
        / (SELECT rmse FROM met WHERE feature_set = 'all') * 100, 4) AS rmse_change_pct
FROM met""",
    "elapsed_format": """
WITH lag AS (SELECT o_orderkey, avg(date_diff('second', o_orderdate, l_shipdate)) AS seconds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT o_orderkey, round(seconds, 3) AS seconds,
  printf('%d:%02d:%02d', CAST(floor(round(seconds) / 3600) AS BIGINT),
         CAST(floor((CAST(round(seconds) AS BIGINT) % 3600) / 60) AS BIGINT),
         CAST(round(seconds) AS BIGINT) % 60) AS elapsed
FROM lag""",
}

_RUN_PARTS = [
    ("linear", "linreg_holdout_metrics", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
    ("linear_cv", "linreg_cv", "best_reg_param", "best_elastic_net_param"),
    ("linear_tvs", "linreg_tvs", "best_reg_param", "best_elastic_net_param"),
]
ORACLE_SQL |= {
    "market_bracket": mk.market_sql(),
    "describe_text": _union([
        f"""SELECT '{c}' AS column_name, count({c}) AS count, {f'round(avg({c}), 4)' if c == 'o_orderkey' else 'CAST(NULL AS DOUBLE)'} AS mean,
            {f'round(stddev_samp({c}), 4)' if c == 'o_orderkey' else 'CAST(NULL AS DOUBLE)'} AS stddev,
            {f"CAST(CAST(min({c}) AS DOUBLE) AS VARCHAR)" if c == 'o_orderkey' else f"CAST(min({c}) AS VARCHAR)"} AS min,
            {f"CAST(CAST(max({c}) AS DOUBLE) AS VARCHAR)" if c == 'o_orderkey' else f"CAST(max({c}) AS VARCHAR)"} AS max FROM orders"""
        for c in TEXT_COLUMNS]),
    "csv_inferred": f"SELECT region_id, median_list_price AS list_price, median_sale_price AS sale_price FROM ({mk.market_sql()}) m",
    "levels_from_files": _union([
        f"SELECT '{lv}' AS region_level, region_id, period_begin, homes_sold, "
        f"{'CAST(NULL AS DOUBLE)' if lv == 'all' else 'inventory'} AS inventory, {LABEL} FROM ({mk.market_sql('month', lv)}) m{i}"
        for i, lv in enumerate(mk.LEVELS)]),
    "linreg_all_first_order": _with(*BASE) + _union([
        f"SELECT '{t}' AS term, count(*) AS n, CAST(0 AS DOUBLE) AS gradient FROM train" for t in ["intercept", *ALL]]),
    "comparison_values": _union([
        f"SELECT '{m}' AS model, 'test' AS eval_on, n, rmse, r2, {a} AS best_reg_param, {b} AS best_elastic_net_param FROM ({ORACLE_SQL[q]}) q{i}"
        for i, (m, q, a, b) in enumerate(_RUN_PARTS)]),
    "stage_status_values": _union([
        f"SELECT '{m}' AS stage, 'Completed' AS status, printf('%.4f', rmse) AS rmse_text, printf('%.4f', r2) AS r2_text FROM ({ORACLE_SQL[q]}) q{i}"
        for i, (m, q, _, _) in enumerate(_RUN_PARTS)]),
}
