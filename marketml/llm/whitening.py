"""Embedding whitening with components found by FEAST contour integration.

Spark sums the covariance of the distinct vectors exactly.  Counts of the matrix's inertia
(an LDL' factorisation of the shifted matrix tells how many eigenvalues lie above the shift)
cut the spectrum's upper end into slices of a few eigenvalues.  For each slice the spectral
projector is a contour integral of the resolvent: a quadrature of complex shifted solves
``(z - V) X = Y`` on a half circle around the slice, whose real part filters a random block.
Rayleigh-Ritz on the filtered block gives the slice's components, and the filter is applied
again until their residuals vanish.  A last Rayleigh-Ritz over all slices makes them
orthogonal, and the numbers found are held against the inertia counts, so none is missed.

Scale: every vector becomes whole numbers.  Equal vectors become one row map-side before the
shuffle, so a hot vector costs one row a task.  A task sends d sums, then d(d+1)/2 sums of
products of numbers centred at the nearest whole mean; Spark adds them as decimals, so the
covariance is exact and the same for every partitioning and order.  Only these d x d sums and
the slices' components reach the driver.  The shifts of a counting round and the slices of the
contour integrals are rows whose tasks share the d x d matrix, so that is the size bound of
what is sent to tasks.

Results by case.  Rows whose vector is null or holds a null, NaN or infinite entry give no row.
Repeated rows are rows of their own but one vector of the fit; rows with a null id count.  Components
of no variance cannot be whitened and are left out, so equal vectors or a single one give no
components and an empty table no rows.  Equal eigenvalues: any basis of their space, the same for
all rows; each component's largest entry is positive.  Vectors of unequal lengths raise an error,
as do entries too large for a whole number.  A deviation beyond 64 bits is null.  The table's other
columns are not read, so their names cannot clash; a column of ``keep`` named ``whitening``
raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketml.llm.common import prepare
from marketml.session import materialize

#: Quadrature nodes on the half circle, rounds of filtering, shifts counted at once, eigenvalues a slice.
NODES, ROUNDS, SHIFTS, SLICE = 8, 40, 32, 8
#: Eigenvalues below this share of the matrix's norm are no variance but rounding.
RANK = 1e-12
_EXACT = 2**53  # sums of whole numbers below this are exact in doubles


def whole(vector: str, scale: int, shift: int):
    """A vector's entries as whole numbers."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * scale) + shift)


def usable(vector: str):
    """True where a vector and all its entries are there and finite."""
    entries = F.col(vector).cast("array<double>")
    return entries.isNotNull() & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(total: np.ndarray, more: np.ndarray) -> np.ndarray:
    return total + more.astype(object)


def _sums(dims: int):
    """A task's sum of every dimension."""

    def run(batches):
        total = np.zeros(dims, object)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                far = max(abs(int(x.min())), abs(int(x.max())))
                total = _added(total, (x if far * len(x) < 2**63 else x.astype(object)).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([int(s) for s in total], pa.decimal128(38, 0))], ["i", "s"])

    return run


def _products(middle: np.ndarray):
    """A task's sums of products of every two dimensions, centred at ``middle``."""
    rows, cols = np.triu_indices(len(middle))

    def run(batches):
        total = np.zeros((len(middle), len(middle)), object)
        for b in batches:
            if b.num_rows:
                y = _matrix(b.column(0)) - middle
                far = max(abs(int(y.min())), abs(int(y.max())))
                y = y.astype(np.float64 if far * far * len(y) < _EXACT else object)
                product = y.T @ y
                total = _added(total, product.astype(np.int64) if y.dtype != object else product)
        sums = [int(s) for s in total[rows, cols]]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(sums, pa.decimal128(38, 0))], ["i", "j", "s"])

    return run


def exact_moments(fit: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of vectors, sums, covariance) of the column ``x`` of whole numbers.
    The covariance's entries are exact fractions rounded once."""
    size = fit.agg(F.count("x").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if not size.n:
        return 0, np.zeros(0, object), np.zeros((0, 0))
    if size.least != size.most:
        raise ValueError(f"vectors of {size.least} to {size.most} entries cannot be whitened together")
    n, dims = size.n, size.most
    sums = np.zeros(dims, object)
    for r in fit.select("x").mapInArrow(_sums(dims), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).toLocalIterator():
        sums[r.i] = int(r.s)
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    rest = [int(s) - n * int(m) for s, m in zip(sums, middle, strict=True)]
    cov = np.zeros((dims, dims))
    products = fit.select("x").mapInArrow(_products(middle), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in products.toLocalIterator():
        cov[r.i, r.j] = cov[r.j, r.i] = (n * int(r.s) - rest[r.i] * rest[r.j]) / (n * n)
    return n, sums, cov


def count_above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie above ``shift``: the positive
    ones among the 1 x 1 and 2 x 2 pivots of a symmetric elimination (Sylvester's law)."""
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(off.argmax(), off.shape)
        if diagonal[k] == 0 and off[r, s] == 0:
            break
        if diagonal[k] >= (1 + 17**0.5) / 8 * off[r, s]:
            pivot = [k]
            above += a[k, k] > 0
        else:
            pivot = [int(r), int(s)]
            above += 1  # such a 2 x 2 pivot has one eigenvalue of each sign
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
    return int(above)


def rayleigh_ritz(v: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors of ``v`` within the span of ``block``."""
    q, _ = np.linalg.qr(block)
    h = q.T @ v @ q
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], (q @ turn)[:, ::-1]


def feast(v: np.ndarray, low: float, high: float, inside: int, seed: int = 0, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The ``inside`` eigenpairs of the symmetric ``v`` in (low, high].  A block that does not
    settle, as eigenvalues crowd outside, is widened; one of all dimensions settles at once."""
    dims, norm = len(v), np.abs(v).sum(0).max()
    rng = np.random.default_rng(seed)
    block = rng.standard_normal((dims, min(dims, 2 * inside + 8)))
    middle, radius = (low + high) / 2, (high - low) / 2
    # Midpoints of equal arcs: the trapezium rule on the circle, whose lower half is the conjugate.
    turn = np.exp(1j * np.pi * (np.arange(nodes) + 0.5) / nodes)
    last = np.inf
    for k in range(rounds):
        filtered = np.zeros_like(block)
        for e in turn:
            z = middle + radius * e
            filtered += (radius * e / nodes * np.linalg.solve(z * np.eye(dims) - v, block)).real
        values, block = rayleigh_ritz(v, filtered)
        found = (values > low) & (values <= high)
        if found.sum() == inside:
            off = np.abs(v @ block[:, found] - block[:, found] * values[found]).max(initial=0.0)
            # Done when the residual is rounding, or near it and no longer falling.
            if off <= 1e-15 * dims * norm or off <= 1e-12 * norm and off > 0.9 * last:
                return values[found], block[:, found]
            last = off
        if k % 8 == 7:
            block = np.concatenate([block, rng.standard_normal((dims, min(block.shape[1], dims - block.shape[1])))], 1)
            last = np.inf
    raise ArithmeticError(f"{found.sum()} of {inside} eigenvalues in ({low}, {high}] after {rounds} rounds")


def _in_tasks(spark: SparkSession, points: list[tuple], schema: str, solve: Callable, out: str) -> list:
    """Apply ``solve`` to each point, one row and one task each."""
    made = pa.schema([(name, {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}[kind]) for name, kind in (c.split() for c in out.split(", "))])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([solve(**p) for p in b.to_pylist()], made)

    frame = spark.createDataFrame(points, schema).repartition(len(points))
    return frame.mapInArrow(run, out).collect()


def slices(spark: SparkSession, v: np.ndarray, want: int, per_slice: int = SLICE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of slices that hold the ``want`` largest eigenvalues
    and those that cannot be told apart from the last of them; fewer if the rank is lower."""
    norm = float(np.abs(v).sum(0).max(initial=0.0))
    if not norm:
        return []
    low, high = RANK * norm, norm * (1 + 1e-9)
    above = {low: count_above(v, low), high: 0}
    want = min(want, above[low])
    if not want:
        return []

    def count(start: float, end: float) -> None:
        shifts = [(float(s),) for s in np.linspace(start, end, SHIFTS + 2)[1:-1]]
        counted = _in_tasks(spark, shifts, "shift double", lambda shift: {"shift": shift, "above": count_above(v, shift)}, "shift double, above int")
        above.update({r["shift"]: r.above for r in counted})

    # Narrow the end below the wanted ones, and look closer at what lies above it.
    while True:
        low = max(s for s in above if above[s] >= want)
        next_ = min(s for s in above if above[s] < want)
        if above[low] <= want + per_slice or next_ - low < 1e-9 * norm:
            break
        count(low, next_)
    count(low, min(s for s in above if not above[s]))
    count(low, min(s for s in above if not above[s]))
    # Neighbouring cells that hold eigenvalues make a slice, until it holds too many.
    cuts = sorted((s for s in above if s >= low), reverse=True)
    found = []
    for high, cut in zip(cuts, cuts[1:], strict=False):
        inside = above[cut] - above[high]
        if found and inside and found[-1][0] == high and found[-1][2] + inside <= per_slice:
            found[-1] = (cut, found[-1][1], found[-1][2] + inside)
        elif inside:
            found.append((cut, high, inside))
    return found


def components(spark: SparkSession, v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a covariance and their unit vectors (columns)."""
    parts = slices(spark, v, want)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def solve(low, high, inside):
        _, vectors = feast(v, low, high, inside)
        return {"vectors": vectors.T.ravel().tolist()}

    solved = _in_tasks(spark, parts, "low double, high double, inside int", solve, "vectors array<double>")
    values, vectors = rayleigh_ritz(v, np.concatenate([np.array(r.vectors).reshape(-1, len(v)) for r in solved]).T)
    low, inside = min(p[0] for p in parts), sum(p[2] for p in parts)
    if (values > low).sum() != inside:
        raise ArithmeticError(f"{(values > low).sum()} components above {low}, the inertia counts {inside}")
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[:want], (vectors * signs)[:, :want]


def _whitened(n: int, middle: np.ndarray, rest: np.ndarray, weights: np.ndarray):
    """Of each row: the exact squared deviation and the whitened vector."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = _matrix(b.column(b.num_columns - 1)) - middle
            centred = y - rest / n
            rough = (centred**2).sum(1) * float(n) ** 2
            part = n * y - rest  # exact wherever the sum of squares fits, wrapped elsewhere
            deviation = [int(s) if r < 2**62 else sum((n * int(e) - int(c)) ** 2 for e, c in zip(line, rest, strict=True)) if r < 2**64 else 2**63
                         for s, r, line in zip((part * part).sum(1), rough, y, strict=True)]
            deviation = pa.array([d if d < 2**63 else None for d in deviation], pa.int64())
            white = pa.FixedSizeListArray.from_arrays(pa.array((centred @ weights).ravel()), weights.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], deviation, white], [*b.schema.names[:-1], "deviation", "whitened"])

    return run


def _errors(n: int, middle: np.ndarray, rest: np.ndarray, weights: np.ndarray):
    """A task's sums of products of the whitened fit vectors."""
    k = weights.shape[1]
    rows, cols = np.triu_indices(k)

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                z = (_matrix(b.column(0)) - middle - rest / n) @ weights
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(total[rows, cols])], ["i", "j", "s"])

    return run


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), want: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Columns ``keep`` of the usable rows with a struct ``whitening``: ``n`` fit vectors,
    the row's ``deviation`` (sum of (n x - S)^2), and ``components``, an array of the number,
    the ``whitened`` value and the ``explained`` share of each; and ``identity_error``, the largest
    absolute entry of the whitened fit vectors' covariance minus the identity."""
    if "whitening" in keep:
        raise ValueError("a kept column is named whitening")
    spark = df.sparkSession
    prepare(spark)
    rows = df.where(usable(vector)).select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], whole(vector, scale, shift).alias("x"))
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    n, sums, cov = exact_moments(fit)
    values, vectors = components(spark, cov, want)
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, middle, strict=True)], np.int64)
    weights = vectors / np.sqrt(values) if len(values) else np.zeros((len(cov), 1))
    error = None
    if len(values):
        # Added as decimals, so that the order of the tasks does not show.
        sent = fit.mapInArrow(_errors(n, middle, rest, weights), "i int, j int, s double")
        summed = sent.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,16)")).alias("s"))
        error = max(abs(float(r.s) / n - (r.i == r.j)) for r in summed.collect())
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "deviation long", "whitened array<double>"])
    done = rows.mapInArrow(_whitened(n, middle, rest, weights), schema)
    share = F.array(*[F.lit(float(e / np.trace(cov))) for e in values]) if len(values) else F.expr("array()").cast("array<double>")
    each = F.zip_with(F.slice("whitened", 1, len(values)), share, lambda w, e: F.struct(w.alias("whitened"), e.alias("explained")))
    each = F.transform(each, lambda c, i: F.struct((i + 1).cast("int").alias("component"), c["whitened"].alias("whitened"), c["explained"].alias("explained")))
    return done.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
                       F.struct(F.lit(n).cast("long").alias("n"), F.col("deviation"), each.alias("components"), F.lit(error).cast("double").alias("identity_error")).alias("whitening"))
