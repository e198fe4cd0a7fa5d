import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketml.operators import features, profile, split


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, float(i % 7), float((i * 3) % 11) if i % 5 else None, i * 2.0) for i in range(200)]
    return spark.createDataFrame(rows, "k int, a double, b double, c double")


def test_describe_matches_pandas(spark, small):
    got = {r.column_name: r for r in profile.describe(small, ["a", "b"]).collect()}
    pdf = small.toPandas()
    for c in ["a", "b"]:
        s = pdf[c].dropna()
        assert got[c]["count"] == len(s)
        assert got[c]["mean"] == pytest.approx(s.mean())
        assert got[c]["stddev"] == pytest.approx(s.std(ddof=1))
        assert (got[c]["min"], got[c]["max"]) == (s.min(), s.max())


def test_summary_exact_and_approx(spark, small):
    ex = {r.column_name: r for r in profile.summary(small, ["a", "c"]).collect()}
    pdf = small.toPandas()
    for c in ["a", "c"]:
        for p, name in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75")]:
            assert ex[c][name] == pytest.approx(pdf[c].quantile(p))
    ap = {r.column_name: r for r in profile.summary(small, ["a"], exact=False).collect()}
    assert ap["a"]["p50"] in set(pdf["a"])


def test_null_profile_and_long(spark, small):
    wide = profile.null_profile(small).first().asDict()
    assert wide == {"k": 0, "a": 0, "b": 40, "c": 0}
    long = {r.column_name: r.null_count for r in profile.null_profile_long(small).collect()}
    assert long == wide


def test_correlation_matrix(spark, small):
    got = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(small, ["a", "c"]).collect()}
    pdf = small.toPandas()
    assert got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "c")] == pytest.approx(pdf["a"].corr(pdf["c"]))
    assert len(got) == 3


def test_series_head_is_top_n_in_order(spark, small):
    head = profile.series_head(small, "a", ["c"], n=5, tiebreak=["k"]).collect()
    pdf = small.toPandas().sort_values(["a", "k"]).head(5)
    assert [r.k for r in head] == list(pdf["k"])


def test_hash_split_is_layout_independent(spark, small):
    key = F.col("k").cast("long")
    a = split.with_split(small, key).select("k", "split")
    b = split.with_split(small.repartition(7).sortWithinPartitions(F.desc("k")), key).select("k", "split")
    assert sorted(a.collect()) == sorted(b.collect())
    counts = {r.split: r.n for r in split.split_counts(a).collect()}
    assert sum(counts.values()) == 200 and 120 <= counts["train"] <= 190


def test_folds_cover_rows(spark, small):
    f = split.with_fold(small, F.col("k").cast("long"), 3)
    counts = {r.fold: r.n for r in split.split_counts(f, "fold").collect()}
    assert set(counts) == {0, 1, 2} and sum(counts.values()) == 200


def test_random_split_partitions_rows(spark, small):
    tr, te = split.random_split(small, (0.8, 0.2), 42)
    assert tr.count() + te.count() == 200
    assert tr.join(te, "k").count() == 0


def test_vector_long(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, x double, y double")
    out = features.vector_long(features.assemble(df, ["x", "y"]), ["k"], ["x", "y"])
    got = sorted((r.k, r.feature, r.value) for r in out.collect())
    assert got == [(1, "x", 2.0), (1, "y", 3.0), (2, "x", 4.0), (2, "y", 5.0)]


def test_ablation_sets():
    assert features.ablation_sets(["a", "b", "c"], ["b"]) == [
        ("all", ["a", "b", "c"]), ("without_b", ["a", "c"])]


def test_market_key_matches_sql(spark):
    df = spark.createDataFrame([(3, "2020-02-01")], "region_id int, d string").select(
        "region_id", F.col("d").cast("date").alias("period_begin"))
    key = df.select(split.market_key()).first()[0]
    days = (pd.Timestamp("2020-02-01") - pd.Timestamp("1970-01-01")).days
    assert key == 3 * 100000 + days


def test_hash_bucket_large_keys_do_not_overflow(spark):
    # A five-digit region id with the day count: beyond what key * mult fits in a long.
    df = spark.createDataFrame([(56045 * 100000 + 18000,), (7,)], "k long")
    got = [r[0] for r in df.select(split.hash_bucket(F.col("k"), 100)).collect()]
    expected = [((k * split.SPLIT_MULT) % split.HASH_MOD) % 100 for k in (56045 * 100000 + 18000, 7)]
    assert got == expected


def test_null_profile_can_count_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "c")], "x double, s string")
    assert profile.null_profile(df).first().asDict() == {"x": 1, "s": 1}
    assert profile.null_profile(df, include_nan=True).first().asDict() == {"x": 2, "s": 1}


def test_observed_profile_equals_the_scans(spark, tmp_path):
    from marketml.operators import profile
    from marketml.session import materialize

    df = spark.createDataFrame([(1, 2.5, "a", True), (None, 7.25, None, False), (3, None, "c", None)], "k int, `v: 1` double, s string, flag boolean")
    for cols in (df.columns, ["k"]):
        part = df.select(*[F.col(f"`{c}`") for c in cols])
        copy, seen = profile.observed(part)
        copy = materialize(copy, "observed-test")
        got = profile.observed_tables(copy, seen)
        plain = {"row_count": profile.row_count(part), "null_profile": profile.null_profile_long(part)}
        if cols == ["k"]:
            plain |= {"schema": profile.schema_table(part), "describe": profile.describe(part)}
        for name, table in plain.items():
            assert got[name].dtypes == table.dtypes and sorted(map(str, got[name].collect())) == sorted(map(str, table.collect())), name
    market = df.drop("v: 1")
    copy, seen = profile.observed(market)
    copy = materialize(copy, "observed-test")
    assert sorted(map(str, profile.observed_tables(copy, seen)["describe"].collect())) == sorted(map(str, profile.describe(market).collect()))
    # None of the four tables scans anything.
    for table in profile.observed_tables(copy, seen).values():
        assert "FileScan" not in table._jdf.queryExecution().executedPlan().toString()
