"""Whitening and hard negatives against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm import hard_negatives, queries, whitening
from tests.conftest import SF_SMALL

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
#: Columns that neither operator reads, with names that they use inside.
CLASHING = {"row": 1, "x": "x", "anchor": None, "n": 2, "key": 3, "whitened": 0.5, "keep_0": 1, "id": 7}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


def plain_whitening(vectors, want=16):
    """(n, deviations, whitened, explained) by a dense eigensolver."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    cov = centred.T @ centred / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(want, int((values > 1e-9 * max(values.max(), 1e-300)).sum()))
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(cov)


def whitened(spark, rows, **params):
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    return df, [(r.vec_id, r.whitening) for r in whitening.whiten(df, **params).collect()]


def check(rows, got, vectors):
    n, deviation, white, share = plain_whitening(vectors)
    assert len(got) == len(vectors)
    for (vec_id, w), i in zip(sorted(got, key=lambda g: g[0]), range(len(vectors)), strict=True):
        assert w.n == n and w.deviation == deviation[i] and w.identity_error < 1e-9
        assert [c.component for c in w.components] == list(range(1, len(share) + 1))
        assert np.allclose([c.explained for c in w.components], share, rtol=1e-9)
        assert np.allclose(np.abs([c.whitened for c in w.components]), np.abs(white[i]), atol=1e-7)


def test_whitening_of_the_table(spark):
    got = queries.op11_whitening(spark, SF_SMALL).orderBy("vec_id", "component").collect()
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, share = plain_whitening([r.embedding for r in table])
    assert len(got) == 16 * len(table) and got[0].n == n and got[0].identity_error < 1e-9
    assert [r.deviation for r in got[::16]] == deviation.tolist()
    assert np.allclose(np.abs([r.whitened for r in got]).reshape(-1, 16), np.abs(white), atol=1e-6)
    assert np.allclose([r.explained for r in got[:16]], share, rtol=1e-9)


def test_whitening_leaves_out_unusable_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 6)).astype(np.float32) * [5, 4, 3, 2, 1, 0.5]
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(good)]
    bad = [(100, None, 0), (101, [None] * 6, 0), (102, [float("nan")] + [0.0] * 5, 1), (103, [float("-inf")] * 6, None)]
    _, got = whitened(spark, rows + bad)
    check(rows, got, [r[1] for r in rows])


def test_copies_count_once_and_keep_their_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(rng.normal(size=(12, 4)))]
    copies = [(100 + i, rows[0][1], None) for i in range(300)]
    _, got = whitened(spark, rows + copies)
    check(rows, got, [r[1] for r in rows + copies])


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    flat = [(i, [float(np.float32(a)), float(np.float32(b)), 1.0, 1.0, 0.25], 0) for i, (a, b) in enumerate(rng.normal(size=(30, 2)))]
    _, got = whitened(spark, flat)
    assert {len(w.components) for _, w in got} == {2}
    check(flat, got, [r[1] for r in flat])
    for rows in ([(1, [1.0, 2.0], 0)] * 3, [(1, [1.0], 0)]):
        _, got = whitened(spark, rows)
        assert [(w.n, w.deviation, w.components, w.identity_error) for _, w in got] == [(1, 0, [], None)] * len(rows)
    assert whitened(spark, [])[1] == [] and whitened(spark, [(1, None, 0)])[1] == []


def test_lengths_and_names(spark):
    with pytest.raises(ValueError, match="1 to 2 entries"):
        whitened(spark, [(1, [1.0], 0), (2, [1.0, 2.0], 0)])
    with pytest.raises(ValueError, match="whitening"):
        whitening.whiten(spark.createDataFrame([], SCHEMA), keep=("whitening",))


def test_equal_eigenvalues(spark):
    """Corners of a cross: every direction has one variance."""
    rows = [(2 * i + (s > 0), [float(8 * s) if j == i else 0.0 for j in range(20)], 0) for i in range(20) for s in (-1, 1)]
    _, got = whitened(spark, rows)
    white = np.array([[c.whitened for c in w.components] for _, w in got])
    assert white.shape == (40, 16) and np.abs(white.T @ white / 40 - np.eye(16)).max() < 1e-12


def test_large_deviations_are_exact_or_null(spark):
    rows = [(i, [float(i * 2.0**k) for k in (14, 18)], 0) for i in range(6)]
    _, got = whitened(spark, rows)
    check(rows, got, [r[1] for r in rows])
    _, got = whitened(spark, [(i, [float(i * 2.0**40)], 0) for i in range(3)])
    x = [i * 2**46 for i in range(3)]
    want = [(3 * v - sum(x)) ** 2 for v in x]
    assert [w.deviation for _, w in sorted(got, key=lambda g: g[0])] == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("seed", range(6))
def test_inertia_and_feast(seed):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    values = np.sort(rng.uniform(0, 10, 30))[::-1]
    values[3] = values[2] - 1e-7  # close ones
    values[8] = values[7]  # and equal ones
    values = np.sort(values)[::-1]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    for shift in (-1.0, 0.5, 5.0, (values[4] + values[5]) / 2, 11.0):
        assert whitening.count_above(v, shift) == (values > shift).sum()
    low = (values[10] + values[11]) / 2
    found, vectors = whitening.feast(v, low, 11.0, 11)
    assert np.allclose(found, values[:11], atol=1e-11) and np.abs(v @ vectors - vectors * found).max() < 1e-11
    with pytest.raises(ArithmeticError):
        whitening.feast(v, low, 11.0, 10, rounds=5)
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def plain_negatives(rows, positives=5, negatives=5):
    """rows: (id, vector, label)."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], label) for i, v, label in rows
            if v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    place = lambda i: (i is None, i or 0)
    for at, (anchor, a, own) in enumerate(kept):
        if anchor is None or anchor % 10:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, v, strict=True)), place(i), i, label) for j, (i, v, label) in enumerate(kept) if j != at), key=lambda s: s[:2])
        for score, _, pos, _ in [s for s in scored if s[3] == own][:positives]:
            windows = [(s, i) for s, _, i, label in scored if label != own and 80 * -score <= 100 * -s <= 100 * -score][:negatives]
            out += [(anchor, pos, rank, i, -score, -s) for rank, (s, i) in enumerate(windows, 1)]
    return sorted(out, key=str)


def mined(spark, rows, parts=3, **params):
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), **params)
    return sorted((tuple(r) for r in found.collect()), key=str)


def _vectors(seed, n, dims=4, labels=3):
    rng = np.random.default_rng(seed)
    # Coarse entries make many equal scores.
    return [(int(i), [float(c) for c in rng.integers(-2, 5, dims) / 4], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 256])
def test_negatives_match_plain(spark, shard_bytes):
    rows = _vectors(0, 240)
    rows += [(500, None, 1), (510, [None] * 4, 1), (520, [float("nan")] * 4, 1), (530, [1.0] * 4, None), (None, [1.0] * 4, 1), (None, [1.0] * 4, 2)]
    want = plain_negatives(rows)
    assert len(want) > 200 and mined(spark, rows, shard_bytes=shard_bytes) == want


def test_a_label_with_many_copies(spark):
    rows = _vectors(1, 30) + [(1000 + i % 7, [1.0, 1.0, 0.5, 0.25], 1) for i in range(1500)] + [(10, [1.0, 1.0, 0.5, 0.25], 1)] * 2
    assert mined(spark, rows, parts=8) == plain_negatives(rows)


def test_held_pairs_are_thinned(spark, monkeypatch):
    """Tasks that hold few pairs give the same result; workers see the small bound through the closure."""
    rows = _vectors(2, 200)
    scores = hard_negatives._scores(np.array([[1, 2], [3, 4]]), np.array([[5, 6]]))
    assert scores.tolist() == [[17], [39]]
    far = np.array([[2**40, 1]])
    assert hard_negatives._scores(far, far).tolist() == [[2**80 + 1]]
    a = np.array([0, 0, 0, 1]), np.array([5, 7, 7, 1]), np.zeros(4, bool), np.array([1, 9, 2, 0]), np.arange(4)
    best = hard_negatives._Best(lambda *c: tuple(x[:2] for x in c))
    monkeypatch.setattr(hard_negatives, "_HELD", 3)
    best.add(*a)
    assert len(best.all()[0]) == 2 and best.held == 0
    assert mined(spark, rows, positives=2, negatives=1) == plain_negatives(rows, 2, 1)


def test_negatives_of_empty_and_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0)]) == []
    assert mined(spark, [(10, [1.0], 0)]) == []
    negative = [(10, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1)]
    assert mined(spark, negative) == plain_negatives(negative) == []
    zero = [(10, [0.0], 0), (1, [1.0], 0), (2, [1.0], 1)]
    assert mined(spark, zero) == plain_negatives(zero) == [(10, 1, 1, 2, 0, 0)]
    with pytest.raises(ValueError, match="1 to 2 entries"):
        mined(spark, [(10, [1.0], 0), (1, [1.0, 2.0], 0)])
    with pytest.raises(ValueError):
        mined(spark, [(10, [1.0], 0), (1, [], 0)])


def test_sort_is_a_secondary_sort(spark):
    pairs = spark.createDataFrame([], "anchor long, key binary, row long")
    plan = hard_negatives._sorted_by_anchor(pairs)._jdf.queryExecution().toString()
    assert "Sort [key" in plan and "hashpartitioning(anchor" in plan.replace("RepartitionByExpression [anchor", "hashpartitioning(anchor")
