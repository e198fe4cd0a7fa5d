import math

import pytest
from pyspark.sql import functions as F

from marketml.functions import elapsed_hms, to_double
from marketml.operators import clean

EDGE_TEXT = ["12.5", "N/A", "", "1.2.3", ".", "-2.5", "12345678.0", None]


def _cast(spark, mode):
    df = spark.createDataFrame([(x,) for x in EDGE_TEXT], "x string")
    return [r[0] for r in df.select(to_double("x", mode)).collect()]


def test_try_cast_keeps_signed_and_large(spark):
    assert _cast(spark, "try_cast") == [12.5, None, None, None, None, -2.5, 12345678.0, None]


def test_digits_only_guard_matches_reference_pattern(spark):
    # The guard lets "1.2.3" and "." through; they must become NULL, not raise.
    assert _cast(spark, "digits_only") == [12.5, None, None, None, None, None, 12345678.0, None]


def test_digits_only_on_double_column_renders_large_values_in_e_notation(spark):
    df = spark.createDataFrame([(12345678.0,), (12.5,), (-1.0,), (float("nan"),)], "x double")
    got = [r[0] for r in df.select(to_double("x", "digits_only")).collect()]
    assert got == [None, 12.5, None, None]


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        to_double("x", "nope")


@pytest.mark.parametrize("secs,text", [
    (0, "0:00:00"), (59.4, "0:00:59"), (59.6, "0:01:00"), (3725, "1:02:05"),
    (90000, "25:00:00"), (None, None),
])
def test_elapsed_hms(spark, secs, text):
    df = spark.createDataFrame([(None if secs is None else float(secs),)], "s double")
    assert df.select(elapsed_hms("s")).first()[0] == text


def _dirty(spark):
    rows = [(1, 1.0, 2.0), (2, None, 3.0), (3, float("nan"), 4.0), (4, 5.0, None), (5, 7.0, 8.0)]
    return spark.createDataFrame(rows, "id int, a double, b double")


def test_drop_missing_all_and_subset(spark):
    df = _dirty(spark)
    assert sorted(r.id for r in clean.drop_missing(df).collect()) == [1, 5]
    assert sorted(r.id for r in clean.drop_missing(df, ["a"]).collect()) == [1, 4, 5]
    assert sorted(r.id for r in clean.drop_missing(df, ["b"]).collect()) == [1, 2, 3, 5]


def test_drop_missing_pushes_is_not_null_to_parquet(spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    _dirty(spark).write.parquet(path)
    plan = clean.drop_missing(spark.read.parquet(path), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(a)" in plan


def test_impute_mean_fills_null_and_nan(spark):
    out = clean.impute_mean(_dirty(spark), ["a"]).orderBy("id").collect()
    mean = (1.0 + 5.0 + 7.0) / 3
    assert [r.a for r in out] == pytest.approx([1.0, mean, mean, 5.0, 7.0])


def test_prepare_policies(spark):
    df = spark.createDataFrame(
        [("1", "N/A", "10"), ("2", "3", "20"), ("3", "4", None)], "k string, x string, y string")
    dropped = clean.prepare(df, ["x"], "y", keys=["k"])
    assert [r.k for r in dropped.collect()] == ["2"]
    imputed = clean.prepare(df, ["x"], "y", keys=["k"], policy="impute").orderBy("k").collect()
    assert [(r.k, r.x) for r in imputed] == [("1", 3.0), ("2", 3.0)]
    assert all(not math.isnan(r.x) for r in imputed)


def test_cast_columns_is_one_projection(spark):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    out = clean.cast_columns(df, ["a", "b"])
    assert dict(out.dtypes) == {"a": "double", "b": "double"}
    assert out.select(F.col("a") + F.col("b")).first()[0] == 3.0
