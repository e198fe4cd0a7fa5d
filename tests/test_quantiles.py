import random

import pytest
from pyspark.sql import functions as F

from marketml.operators import quantiles as Q
from marketml.operators.quantiles import exact_median, exact_quantiles, exact_quantiles_long

METHODS = ["bracket", "sort"]


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # One group holds a third of all rows, with long runs of equal values.
        g = 0 if i % 3 == 0 else rnd.randint(1, 40)
        v = float(rnd.randint(0, 5)) if g == 0 else rnd.uniform(-100, 100)
        if i % 97 == 0:
            v = None
        rows.append((i, g, v, rnd.uniform(0, 1)))
    return spark.createDataFrame(rows, "id long, g int, v double, w double")


@pytest.mark.parametrize("method", METHODS)
def test_median_matches_spark_percentile(spark, method):
    df = _skewed(spark)
    ours = exact_median(df, ["g"], ["v", "w"], tiebreak=F.xxhash64("id"), method=method)
    ref = df.groupBy("g").agg(F.median("v").alias("rv"), F.median("w").alias("rw"))
    rows = ours.join(ref, "g").collect()
    assert len(rows) == 41
    for r in rows:
        assert r.v == r.rv and r.w == r.rw


@pytest.mark.parametrize("method,parts,accuracy", [
    ("sort", 1, 10000), ("sort", 16, 10000), ("bracket", 3, 10000),
    ("bracket", 8, 20),   # coarse sketches: wide brackets, interior selection
])
def test_quartiles_any_partitioning(spark, method, parts, accuracy):
    df = _skewed(spark)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    ours = exact_quantiles(df, ["g"], ["v"], probs, num_partitions=parts, method=method,
                           accuracy=accuracy)
    ref = df.groupBy("g").agg(*[F.percentile("v", p).alias(f"r{i}") for i, p in enumerate(probs)])
    for r in ours.join(ref, "g").collect():
        for i, p in enumerate(probs):
            assert r[f"v_p{round(p * 100)}"] == pytest.approx(r[f"r{i}"], rel=1e-15, abs=1e-12)


def test_bracket_fallback_is_still_exact(spark, monkeypatch):
    # Inverted brackets never hold the wanted rank, so every group takes the
    # sort-method fallback.
    monkeypatch.setattr(Q, "BRACKET_SLACK", -50.0)
    df = _skewed(spark)
    ours = exact_quantiles(df, ["g"], ["v"], (0.25, 0.5), accuracy=100, method="bracket")
    ref = df.groupBy("g").agg(F.percentile("v", 0.25).alias("a"), F.percentile("v", 0.5).alias("b"))
    for r in ours.join(ref, "g").collect():
        assert r.v_p25 == pytest.approx(r.a) and r.v_p50 == pytest.approx(r.b)


@pytest.mark.parametrize("method", METHODS)
def test_global_quantiles_and_counts(spark, method):
    df = _skewed(spark)
    long = exact_quantiles_long(df, [], ["v"], (0.5,), method=method)
    row = long.first()
    assert row.n == df.where(F.col("v").isNotNull()).count()
    assert row.quantile == df.agg(F.median("v")).first()[0]


def test_null_group_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    got = {r.g: r.v for r in exact_median(df, ["g"], ["v"]).collect()}
    assert got == {None: 2.0, 1: 5.0}


def test_hot_group_spreads_over_partitions(spark):
    """The hot group's rows sort into several range partitions, so no single
    task holds the whole group."""
    from marketml.session import materialize

    df = _skewed(spark, n=6000)
    order = ["g", "_v", "_t"]
    st = df.select("g", F.col("v").alias("_v"), F.xxhash64("id").alias("_t")).where("_v IS NOT NULL")
    ranked = materialize(st.repartitionByRange(8, *order).select("g", F.spark_partition_id().alias("pid")),
                         "test-ranked")
    hot_parts = ranked.where("g = 0").select("pid").distinct().count()
    assert hot_parts >= 2


@pytest.mark.parametrize("n,groups", [(3000, 40), (20000, 4)])
def test_bracket_does_not_need_the_fallback(spark, monkeypatch, n, groups):
    calls = []
    orig = Q._rank_select

    def spy(stacked, gkeys, parts, probs=None, wanted=None):
        calls.append(list(gkeys))
        return orig(stacked, gkeys, parts, probs=probs, wanted=wanted)

    monkeypatch.setattr(Q, "_rank_select", spy)
    df = spark.range(n).select(
        F.col("id"), (F.col("id") % groups).cast("int").alias("g"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 6).cast("double")).otherwise(F.rand(3) * 100).alias("v"))
    exact_quantiles(df, ["g"], ["v"], (0.0, 0.25, 0.5, 0.9, 1.0), method="bracket").collect()
    # Only the interior selection runs (its keys carry the probability).
    assert all("_p" in c for c in calls)


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None)
@given(
    rows=st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-5, 5).map(float))),
                  min_size=1, max_size=60),
    p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]),
    method=st.sampled_from(["sort", "bracket"]),
)
def test_property_matches_percentile(spark, rows, p, method):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id long, g int, v double")
    ours = {r.g: r.v for r in exact_quantiles(df, ["g"], ["v"], (p,), method=method, accuracy=50).collect()}
    ref = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", p).alias("q")).collect()
           if r.q is not None}
    assert set(ours) == set(ref)
    for g, q in ref.items():
        assert ours[g] == pytest.approx(q, abs=1e-12)


def test_wider_groups_sort_only_between_their_parts(spark, monkeypatch):
    from marketml.operators import quantiles

    rng = random.Random(2)
    rows = [(f, w, float(rng.randrange(200) + 100 * (w or 0)), rng.choice([None, rng.gauss(0, 1)])) for f, w in [(0, 0), (1, 0), (2, 1), (None, None), (3, None)] for _ in range(rng.randrange(300, 500))]
    # A part of two wider groups: neither lies between its parts.
    rows += [(4, w, 1000.0 * w, None) for w in (0, 1) for _ in range(700)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, f int, w int, x double, y double").repartition(5)
    sorted_rows, select = [], quantiles._rank_select
    monkeypatch.setattr(quantiles, "_rank_select", lambda stacked, *a, **k: sorted_rows.append(stacked.count()) or select(stacked, *a, **k))
    up = lambda d, columns: d.select("w", *columns)
    fine, wide = quantiles.exact_medians_rolled_up(df, ["f"], {"x": F.col("x"), "y": F.col("y")}, df.select("f", "w").distinct(), up, ["w"], F.xxhash64("id"))
    for got, key in ((fine, "f"), (wide, "w")):
        want = {r[0]: r[1:] for r in df.groupBy(key).agg(F.median("x"), F.median("y")).collect()}
        got = {r[0]: r[1:] for r in got.collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k])
    values = sum(x is not None for r in rows for x in r[2:])
    assert sorted_rows[0] == values and sum(sorted_rows[1:]) < values
