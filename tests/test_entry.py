"""Driver contract and the SQL oracle gate on the smallest tables."""

import pytest

import __spark_entry__ as entry_mod
from marketml.plans.workflows import prepared_market
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
# Every oracle-checked query (all are cheap at sf0.001).
FAST = [
    "market_base", "scan_select", "schema_table", "union_levels", "clean_regex_cast",
    "drop_null_any", "impute_mean", "null_profile", "summary_quartiles", "correlation_matrix",
    "series_head", "hash_split_counts", "fold_counts", "assemble_vector", "linreg_2f_coef",
    "linreg_predictions", "elastic_net_metrics", "tree_stump", "param_grid", "linreg_cv",
    "linreg_tvs", "best_model", "ablation", "elapsed_format",
    "csv_roundtrip", "sql_view", "clean_try_cast", "drop_null_subset", "row_count", "describe",
    "linreg_1f_coef", "linreg_holdout_metrics", "linreg_cv_fold_rmse", "market_day",
    "linreg_cv_candidates", "summary_by_level", "market_bracket", "describe_text", "csv_inferred",
    "levels_from_files", "linreg_all_first_order", "comparison_values", "stage_status_values",
    "tree_exact_metrics", "tree_exact_importance", "forest_one_tree", "gbt_two_iterations",
    "tree_exact_cv", "tree_exact_tvs", "linreg_imputed",
    "tree_d5_metrics", "gbt_metrics", "forest_three_trees",
    "elastic_net_all_features", "linreg_cv_all_features", "ablation_all",
]


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and df.columns == ["n", "rmse", "r2", "mae"]


def test_every_oracle_has_a_query():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert set(FAST) == set(entry_mod.registry.ORACLE_SQL)
    assert len(q) >= 45


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def prepared(spark):
    with prepared_market(spark, SF) as sf:
        yield sf


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, con, prepared, name):
    ok, _, msg = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], prepared)
    assert ok, msg


def test_a_query_builds_its_own_market(spark, con):
    name = "linreg_1f_coef"
    ok, _, msg = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF)
    assert ok, msg
