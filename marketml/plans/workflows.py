"""End-to-end model runs in the shape of the reference scripts: split, fit a
baseline, tune by cross-validation and by train-validation, score every run
on the same holdout rows, and return comparison tables.

Differences from the reference, on purpose: the split and folds are key
hashes (deterministic on any layout); tuned models are fitted on training
rows only and scored on the holdout like the baseline; the time reported for
a run is the time of the fit whose metrics are reported; every estimator
has a seed.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketml.operators.evaluate import metrics_dict
from marketml.operators.moments import moments, score, solve
from marketml.operators.split import market_key, with_fold, with_split, with_validation
from marketml.plans import models, tuning
from marketml.plans.presets import PRESETS
from marketml.plans.report import RunRecord
from marketml.session import materialize, scratch_path, scratch_scope
from marketml.sources.market import FEATURES, LABEL, build_market

# The reference's tuning grids and fold counts per family (from the presets).
REFERENCE_GRIDS: dict[str, dict[str, list]] = {p.family: p.grid for p in PRESETS.values()}
REFERENCE_FOLDS: dict[str, int] = {p.family: p.folds for p in PRESETS.values()}
# Candidate fits in flight at once.  The reference used 1 or 2; small fits
# are bound by per-job latency, so overlapping them pays off.
TUNING_PARALLELISM = 4


def market_table(spark: SparkSession, sf_dir: str, grain: str = "month",
                 level: str = "nation") -> DataFrame:
    """The market table, built and written once to the shared checkpoint
    folder.  Its own intermediates are deleted; the written table belongs to the
    caller's scratch scope."""
    path = scratch_path(spark, f"market-{grain}-{level}")
    with scratch_scope(spark):
        build_market(spark, sf_dir, grain, level).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


class Prepared(str):
    """A folder of tables that carries its market table: passed in place of the
    folder, it lets several queries read one build."""

    market: DataFrame


@contextmanager
def prepared_market(spark: SparkSession, sf_dir: str):
    """Owns a market table and all scratch of the queries run inside the block."""
    with scratch_scope(spark):
        out = Prepared(sf_dir)
        out.market = market_table(spark, sf_dir)
        yield out


def model_frame(market: DataFrame, folds: int = 3) -> DataFrame:
    """Market rows with ``row_key``, ``split``, ``fold`` and
    ``is_validation`` columns (all hashes of the row key)."""
    df = market.withColumn("row_key", market_key())
    df = with_split(df, F.col("row_key"))
    df = with_fold(df, F.col("row_key"), folds)
    return with_validation(df, F.col("row_key"))


@dataclass
class FamilyRun:
    family: str
    features: list
    runs: list  # RunRecord: baseline, cross-validation, train-validation
    baseline_model: object
    cv_model: object
    tvs_result: object
    grid_rows: list


def _timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return out, time.perf_counter() - t0


STAGES = ("baseline", "cv", "tvs")


def run_family(frame: DataFrame, family: str, features: Sequence[str] = FEATURES,
               label: str = LABEL, grid: Mapping[str, list] | None = None,
               folds: int | None = None, parallelism: int | None = None,
               tune: bool = True, stages: Sequence[str] | None = None,
               impute: bool = False) -> FamilyRun:
    """Baseline, cross-validation and train-validation for one model family
    (``stages`` picks a subset).  All runs are scored on the same holdout.
    ``impute`` fills missing features with means that each fit takes from its
    own training rows."""
    features = list(features)
    grid = grid or REFERENCE_GRIDS[family]
    folds = folds or REFERENCE_FOLDS[family]
    parallelism = parallelism or TUNING_PARALLELISM
    stages = list(stages or (STAGES if tune else ("baseline",)))
    train = with_fold(frame.where(F.col("split") == "train"), F.col("row_key"), folds)
    test = frame.where(F.col("split") == "test")
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        pipe = models.pipeline(family, features, label, impute=impute, binned=True)
        maps = tuning.grid(pipe.getStages()[-1], grid)
        rows = tuning.grid_rows(maps)
        nested = family == "tree" and set(grid) == {"maxDepth"}
        runs, base, cv_model, tvs = [], None, None, None
        if "baseline" in stages:
            base, secs = _timed(lambda: pipe.fit(train))
            m = metrics_dict(base.transform(test), label)
            runs.append(RunRecord(family, "test", m["n"], m["rmse"], m["r2"], secs))
        if "cv" in stages:
            if family == "linear" and not impute and set(grid) <= {"regParam", "elasticNetParam"}:
                cv_model, secs = _timed(lambda: tuning.linear_cross_validate(pipe, maps, train, features, label, "fold"))
            elif nested:
                cv_model, secs = _timed(lambda: tuning.nested_cross_validate(pipe, maps, train, label, "fold", folds, parallelism))
            else:
                cv_model, secs = _timed(lambda: tuning.fold_cross_validate(
                    pipe, maps, train, label, "fold", folds, max(parallelism, 8)))
            m = metrics_dict(cv_model.transform(test), label)
            # Read the chosen values off the refitted best model.
            best = models.param_values(cv_model.bestModel, list(grid))
            runs.append(RunRecord(f"{family}_cv", "test", m["n"], m["rmse"], m["r2"], secs, best))
        if "tvs" in stages:
            if nested:
                tvs, secs = _timed(lambda: tuning.nested_train_validate(pipe, maps, train, label, "is_validation"))
            else:
                tvs, secs = _timed(lambda: tuning.train_validate(
                    pipe, maps, train, label, "is_validation", parallelism))
            m = metrics_dict(tvs.model.transform(test), label)
            best = models.param_values(tvs.model, list(grid))
            runs.append(RunRecord(f"{family}_tvs", "test", m["n"], m["rmse"], m["r2"], secs, best))
        return FamilyRun(family, features, runs, base, cv_model, tvs, rows)
    finally:
        train.unpersist()


def with_model_columns(df: DataFrame, key, folds: int = 3, train_pct: int = 80) -> DataFrame:
    """Add ``row_key``, ``split``, ``fold`` and ``is_validation`` to any
    table from a non-negative integer key below 2^31 (or a list of key
    columns, hashed with ``xxhash64`` into that range)."""
    if isinstance(key, (list, tuple)):
        key = F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(2147483647))
    df = df.withColumn("row_key", key)
    df = with_split(df, F.col("row_key"), train_pct)
    df = with_fold(df, F.col("row_key"), folds)
    return with_validation(df, F.col("row_key"))


def regression_report(spark: SparkSession, df: DataFrame, features: Sequence[str], label: str,
                      family: str, keys: Sequence[str], grid: Mapping[str, list] | None = None,
                      folds: int | None = None, tune: bool = True,
                      impute: bool = False) -> dict[str, DataFrame]:
    """The whole reference workflow for one family on any cleaned table
    (see :func:`marketml.operators.clean.prepare`, with policy ``label`` where
    ``impute`` fills features inside the fits): returns ``comparison``
    (O1, O2, O4), ``status`` (O5), ``importance`` (O3: importances for
    trees, coefficients for linear) and ``candidates`` (T6)."""
    from marketml.plans.report import comparison, stage_status

    frame = with_model_columns(df, list(keys), folds or REFERENCE_FOLDS[family])
    run = run_family(frame, family, features, label, grid, folds, tune=tune, impute=impute)
    cmp_ = comparison(spark, run.runs)
    if family == "linear":
        train = frame.where(F.col("split") == "train")
        imp = models.coefficients(spark, run.baseline_model, run.features,
                                  models.feature_stddevs(train, run.features))
        imp = imp.where(F.col("term") != "intercept").orderBy(F.desc("abs_coefficient"))
    else:
        imp = models.importances(spark, run.baseline_model, run.features, family)
        if run.cv_model is not None:
            # The reference's forest script reads importances off the CV best
            # model; both are returned, labelled by source_model.
            imp = imp.unionByName(models.importances(
                spark, run.cv_model.bestModel, run.features, f"{family}_cv"))
    out = {"comparison": cmp_, "status": stage_status(cmp_), "importance": imp}
    if run.cv_model is not None:
        maps = tuning.grid(models.regressor(run.baseline_model), grid or REFERENCE_GRIDS[family])
        out["candidates"] = tuning.candidate_table(spark, run.cv_model, maps)
    return out


def eda_report(df: DataFrame, numeric: Sequence[str], time_col: str | None = None,
               label: str = LABEL, summary_cols: Sequence[str] | None = None,
               head: int = 10, seen: Observation | None = None) -> dict[str, DataFrame]:
    """The profiling half of the boosted script as tables: schema with
    non-NULL counts, describe, null profile, ordered series head, summaries
    with exact quartiles and the correlation matrix (S13, G1-G4, G7, A1, A2).
    ``seen`` is an observation of ``df`` (``profile.observed``) that an earlier action has filled; the first
    three tables and the row count then need no scan."""
    from marketml.operators import profile

    numeric = [c for c in numeric if c in df.columns]
    out = profile.observed_tables(df, seen) if seen else {
        "schema": profile.schema_table(df),
        "row_count": profile.row_count(df),
        "describe": profile.describe(df),
        "null_profile": profile.null_profile_long(df),
    }
    out |= {
        "summary": profile.summary(df, [c for c in (summary_cols or numeric) if c in df.columns]),
        "correlation": profile.correlation_matrix(df, numeric),
    }
    if time_col and time_col in df.columns:
        # Every other column that can be ordered breaks ties of the time column.
        rest = [c for c, t in df.dtypes if c != time_col and not t.startswith(("map", "variant"))]
        out["series_head"] = profile.series_head(df, time_col, [label], head, rest).select(time_col, label)
    return out


#: Reader options that change how values are written; inference is then the reader's.
_OWN_FORMATS = {"dateformat", "timestampformat", "timestampntzformat", "locale", "nanvalue", "positiveinf", "negativeinf", "preferdate", "samplingratio", "enabledatetimeparsingfallback"}


def reference_workflow(spark: SparkSession, path: str, script: str, fmt: str = "csv",
                       keys: Sequence[str] | None = None, grid: Mapping[str, list] | None = None,
                       tune: bool = True, options: Mapping[str, str] | None = None
                       ) -> dict[str, DataFrame]:
    """Repeat one of the reference's scripts (``linear``, ``tree``,
    ``forest``, ``gbt``) on a file: scan with a header and inferred schema,
    drop its listed columns, clean as that script did (guarded cast, cast,
    impute or none), then baseline + CV + train-validation on one holdout,
    and for ``gbt`` the ablation and the profiling tables.

    ``keys`` name the columns whose hash splits rows; by default the model
    columns themselves are hashed, which is still layout-independent.
    """
    from marketml.operators import profile
    from marketml.operators.clean import drop_missing, prepare
    from marketml.plans.presets import HEATMAP_COLUMNS, SUMMARY_COLUMNS
    from marketml.sources.tables import drop_columns, read_csv_typed, read_table

    preset = PRESETS[script]
    opts = {"header": "true", "inferSchema": "true"} if fmt == "csv" else {}
    opts.update(options or {})
    seen = None
    if fmt == "csv" and str(opts["inferSchema"]).lower() == "true" and not _OWN_FORMATS & {k.lower() for k in opts}:
        raw = read_csv_typed(spark, path, **{k: v for k, v in opts.items() if k != "inferSchema"})
    else:
        raw = read_table(spark, path, fmt, options=opts)
    raw = drop_columns(raw, preset.drop_columns)
    if fmt == "csv":
        # Cleaning, profiles and every fit read the input again: later passes scan column-pruned
        # Parquet, whose write gathers the profiles on the way.
        raw, seen = profile.observed(raw)
        raw = materialize(raw, f"{script}-input")
    feats, label = list(preset.features), preset.label
    impute = preset.policy == "impute"  # inside the fits, from training rows
    keys = list(keys or [])
    if missing := [k for k in keys if k not in raw.columns]:
        raise ValueError(f"no such key columns: {missing}")
    if preset.clean_mode is None:
        df = drop_missing(raw.select(*keys, *feats, label))
    else:
        df = prepare(raw, feats, label, keys, preset.clean_mode, "label" if impute else preset.policy)
    out = regression_report(spark, df, feats, label, preset.family, keys or [*feats, label],
                            grid or preset.grid, preset.folds, tune, impute)
    if script == "gbt":
        out.update(eda_report(raw, list(HEATMAP_COLUMNS), "period_begin", label, SUMMARY_COLUMNS, seen=seen))
        frame = with_model_columns(df, keys or [*feats, label], preset.folds)
        out["ablation"] = ablation_report(spark, frame, preset.family, feats, label, preset.ablate, impute=impute)
    return out


def linear_ablations(spark: SparkSession, frame: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Holdout scores of linear fits on all features and without each one, with the change against all
    (M4), from one scan of the frame: ``(feature_set, n_features, n, rmse, r2, rmse_change, rmse_change_pct)``."""
    features = list(features)
    by_split = moments(frame, [*features, label], "split")
    if not {"train", "test"} <= set(by_split):
        raise ValueError("the frame needs training and test rows")
    rows, full = [], None
    for name, out in [("all", None), *[(f"without_{f}", i) for i, f in enumerate(features)]]:
        places = [i for i in range(len(features) + 1) if i != out]
        train, test = (by_split[s].of(places) for s in ("train", "test"))
        s = score(test, *solve(train))
        full = full or s["rmse"]
        rows.append((name, len(places) - 1, s["n"], s["rmse"], s["r2"], s["rmse"] - full, (s["rmse"] - full) / full * 100 if full else None))
    return spark.createDataFrame(rows, "feature_set string, n_features int, n long, rmse double, r2 double, rmse_change double, rmse_change_pct double")


def ablation_report(spark: SparkSession, frame: DataFrame, family: str, features: Sequence[str],
                    label: str, drop: Sequence[str], **params) -> DataFrame:
    """Refit without each feature in ``drop`` (everything else fixed) and
    report holdout RMSE/R^2 with the change against the full set (M4)."""
    from pyspark.sql import Window

    from marketml.operators.evaluate import regression_metrics
    from marketml.operators.features import ablation_sets

    train = frame.where(F.col("split") == "train")
    test = frame.where(F.col("split") == "test")
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    sets = ablation_sets(features, drop)
    try:
        # Side by side: a small fit is bound by the latency of its jobs.
        with ThreadPool(TUNING_PARALLELISM) as pool:
            fitted = pool.map(lambda s: models.fit(train, family, s[1], label, binned=True, **params), sets, chunksize=1)
    finally:
        train.unpersist()
    name = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.lit(len(f)).alias("n_features")) for n, f in sets])
    parts = models.predict_each(fitted, test, [label]).select(
        F.element_at(name, F.col("point") + 1).alias("s"), label, "prediction").select("s.*", label, "prediction")
    met = regression_metrics(parts, label, group_cols=["feature_set", "n_features"])
    # A window over one metrics row per feature set, not over data rows.
    full = F.max(F.when(F.col("feature_set") == "all", F.col("rmse"))).over(Window.partitionBy())
    return met.select("feature_set", "n_features", "n", "rmse", "r2",
                      (F.col("rmse") - full).alias("rmse_change"),
                      ((F.col("rmse") - full) / full * 100).alias("rmse_change_pct"))
