"""Hard negatives by a secondary-sort shuffle.

Pair scores travel as packed keys (anchor, descending score, positives before others, id).  They are
partitioned by anchor and sorted within partitions by that key, in the JVM and with
spill.  A streaming iterator then reads each anchor's pairs in order: a positive opens a
window from its score down to ``low`` percent of it, and each row of another label that
follows goes out as a negative of every open window that still wants one.  Nothing of an anchor is
held but its open windows.

Scores are whole numbers: inner products of whole vectors, exact in doubles where they are
below 2^53 and in integers elsewhere.

Scale: anchors are a stated query set against all rows, in blocks.  The rows stay where they lie; a
shard of anchors, whose bytes are bounded by ``shard_bytes``, is sent to all tasks, and every
further shard is a pass of its own.  Each task multiplies the shard with its rows batch by batch.
The first pass of a shard sends every task's best ``positives`` rows of the
anchor's label, so an anchor's windows are known.  The second sends, for each window, a task's first
``negatives`` rows in it: the first of all tasks are among the first of each, so
nothing is lost and an anchor's stream is short however many rows share its label.  The
work is (anchors x rows) products, as the full search asks for.

Results by case.  Rows whose label or vector is null, or with a null or non-finite entry, take no part.  A
null id is never divisible, so such a row is no anchor, and it comes last among equal scores.  Repeated
rows are rows of their own: a copy of the anchor may be its positive, and two anchors of one
id both give rows.  Ties go to the smaller id; rows of equal score and id are alike in the
result.  An anchor without positives or without rows in its windows gives none, nor does a positive
whose score is negative (its window is empty); an empty table gives an empty
result.  Vectors of unequal lengths and scores beyond 64 bits raise an error.  Only the named columns are read, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketml.llm.common import prepare
from marketml.llm.whitening import usable, whole
from marketml.session import write_scratch

SHARD_BYTES = 16 << 20
_CELLS = 1 << 21  # scores that a task computes at once
_HELD = 1 << 19  # candidate pairs that a task holds before it thins them
_SIGN = np.uint64(1 << 63)
#: A key's bytes: big-endian parts whose order as bytes is the order of the pairs.
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("other", "u1"), ("no_id", "u1"), ("id", ">u8")])
_PAIRS = pa.schema([("anchor", pa.int64()), ("key", pa.binary()), ("row", pa.int64())])
_PAIRS_SQL = "anchor long, key binary, row long"


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, id, whether it is null, label, vectors) of a batch."""
    ids = batch.column("id")
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return batch.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("label").to_numpy(), x


def _cells(batches, anchors: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The batches' rows in pieces whose scores with all anchors fit in bounded memory."""
    step = max(1, _CELLS // max(anchors, 1))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield _rows(b.slice(at, step))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of every two rows."""
    far = lambda m: max(abs(int(m.min())), abs(int(m.max())))
    bound = far(a) * far(b) * a.shape[1] if a.size and b.size else 0
    kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64 if bound < 2**63 else object)


def _packed(anchor, score, other, no_id, ids, row) -> pa.RecordBatch:
    key = np.empty(len(anchor), _KEY)
    key["anchor"], key["other"], key["no_id"] = anchor, other, no_id
    key["score"] = ~(score.astype(np.int64).astype(np.uint64) ^ _SIGN)
    key["id"] = ids.astype(np.uint64) ^ _SIGN
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY.itemsize), len(key), [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), packed, pa.array(row, pa.int64())], schema=_PAIRS)


def _unpacked(keys: pa.Array) -> Iterator[tuple[int, int, bool, int | None]]:
    """(anchor, score, is no positive, id) of packed keys."""
    key = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    score = (~key["score"].astype(np.uint64) ^ _SIGN).astype(np.int64)
    ids = (key["id"].astype(np.uint64) ^ _SIGN).astype(np.int64)
    for a, s, other, no_id, i in zip(key["anchor"].tolist(), score.tolist(), key["other"].tolist(), key["no_id"].tolist(), ids.tolist(), strict=True):
        yield a, s, bool(other), None if no_id else i


def _first(group: np.ndarray, score: np.ndarray, no_id: np.ndarray, ids: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order of pairs by group, falling score, id."""
    return np.lexsort((row, ids, no_id, -score, group))


def _rank(group: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """How many counted pairs of its group lie up to each pair; groups lie together."""
    total = np.cumsum(counted)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    before = (total - counted)[start]
    return total - np.repeat(before, np.diff(np.r_[start, len(group)]))


class _Best:
    """Pairs that a task may have to send, thinned whenever many are held."""

    def __init__(self, thin):
        self.thin, self.parts, self.held = thin, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > _HELD:
            self.parts = [self.all()]
            self.held = 0  # what a thinning leaves is bounded by the shard

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return self.thin(*[np.concatenate(c) for c in zip(*self.parts, strict=True)])


def _positives(row: np.ndarray, label: np.ndarray, x: np.ndarray, most: int):
    """A task's ``most`` best rows of the label of every anchor of a shard."""

    def thin(a, score, no_id, ids, r):
        order = _first(a, score, no_id, ids, r)
        order = order[_rank(a[order], np.ones(len(order), np.int64)) <= most]
        return a[order], score[order], no_id[order], ids[order], r[order]

    def run(batches):
        best = _Best(thin)
        least = np.full(len(row), np.iinfo(np.int64).min)  # lower scores cannot be among the anchor's best
        for r, ids, no_id, labels, vectors in _cells(batches, len(row)):
            scores = _scores(x, vectors)
            mine = (label[:, None] == labels[None]) & (row[:, None] != r[None]) & (scores >= least[:, None])
            a, k = np.nonzero(mine)
            best.add(a, scores[a, k].astype(np.int64), no_id[k], ids[k], r[k])
            if len(r) >= most and scores.dtype != object:
                kth = np.partition(np.where(mine, scores, np.iinfo(np.int64).min), len(r) - most, axis=1)
                least = np.maximum(least, kth[:, len(r) - most])
        a, score, no_id, ids, r = best.all()
        yield _packed(row[a], score, np.zeros(len(a), np.uint8), no_id, ids, r)

    return run


def _negatives(row: np.ndarray, label: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, most: int):
    """A task's first ``most`` rows of another label in each window (low, high) of every anchor."""
    open_ = low <= high
    least = np.where(open_, low, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
    largest = np.where(open_, high, np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)

    def thin(a, score, no_id, ids, r):
        order = _first(a, score, no_id, ids, r)
        a, score, no_id, ids, r = a[order], score[order], no_id[order], ids[order], r[order]
        wanted = np.zeros(len(a), bool)
        for p in range(low.shape[1]):
            within = (score >= low[a, p]) & (score <= high[a, p])
            wanted |= within & (_rank(a, within.astype(np.int64)) <= most)
        return a[wanted], score[wanted], no_id[wanted], ids[wanted], r[wanted]

    def run(batches):
        best = _Best(thin)
        for r, ids, no_id, labels, vectors in _cells(batches, len(row)):
            scores = _scores(x, vectors)
            a, k = np.nonzero((scores >= least[:, None]) & (scores <= largest[:, None]) & (label[:, None] != labels[None]))
            best.add(a, scores[a, k].astype(np.int64), no_id[k], ids[k], r[k])
        a, score, no_id, ids, r = best.all()
        yield _packed(row[a], score, np.ones(len(a), np.uint8), no_id, ids, r)

    return run


def _best_positives(most: int):
    """The first ``most`` pairs of each anchor of a sorted stream."""

    def run(batches):
        anchor, taken = None, 0
        for b in batches:
            chosen = []
            for n, (a, _, _, _) in enumerate(_unpacked(b.column("key"))):
                if a != anchor:
                    anchor, taken = a, 0
                taken += 1
                if taken <= most:
                    chosen.append(n)
            yield b.take(pa.array(chosen, pa.int64()))

    return run


_FOUND = pa.schema([("anchor", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])


def _open_windows(percent: int, most: int):
    """Negatives of the windows that a sorted stream's positives open."""

    def run(batches):
        anchor, windows = None, []  # each open window: positive's id, its score, negatives so far
        for b in batches:
            found = []
            for a, score, other, i in _unpacked(b.column("key")):
                if a != anchor:
                    anchor, windows = a, []
                if not other:
                    windows.append([i, score, 0])
                    continue
                windows = [w for w in windows if w[2] < most and percent * w[1] <= 100 * score]
                for w in windows:
                    w[2] += 1
                    found.append((a, w[0], w[2], i, w[1], score))
            columns = list(zip(*found, strict=True)) or [()] * len(_FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def _sorted_by_anchor(pairs: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's pairs lie in one partition, in key order."""
    return pairs.repartition("anchor").sortWithinPartitions("key")


def mine(df: DataFrame, anchors: Column, label: Column, vector: str = "embedding", id: str = "vec_id", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: of every
    anchor's ``positives`` best rows of its label, the first ``negatives`` rows of other labels that score
    from ``low`` to 100 percent of the positive.  ``anchors`` tells which rows are anchors, ``label``
    is a whole number."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.where(usable(vector) & label.isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), whole(vector, scale, 0).alias("x"))
    rows = spark.read.parquet(write_scratch(rows, "negatives-rows"))
    size = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).first()
    if size.least != size.most:
        raise ValueError(f"vectors of {size.least} to {size.most} entries have no inner product")
    # A hash of the row number deals anchors to shards; it is uniform, so shards are near their mean, half the bound.
    shards = -(-2 * size.anchors * 8 * (size.most or 0) // shard_bytes)
    chosen = rows.where("anchor").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(max(shards, 1))))
    data = rows.select("row", "id", "label", "x")
    found = []
    for k in range(shards):
        shard = chosen.where(F.col("shard") == k).select("row", "id", "label", "x").toArrow().combine_chunks()
        if not shard.num_rows:
            continue
        row, _, _, own, x = _rows(shard.to_batches()[0])
        pairs = data.mapInArrow(_positives(row, own, x, positives), _PAIRS_SQL)
        best = _sorted_by_anchor(pairs).mapInArrow(_best_positives(positives), _PAIRS_SQL)
        best = spark.read.parquet(write_scratch(best, "negatives-positives"))
        at = {int(a): n for n, a in enumerate(row)}
        top, bottom, filled = np.full((len(row), positives), -1, np.int64), np.zeros((len(row), positives), np.int64), np.zeros(len(row), np.int64)
        for a, score, _, _ in _unpacked(best.select("key").toArrow().column(0)):  # at most ``positives`` an anchor of the shard
            n = at[a]
            top[n, filled[n]], bottom[n, filled[n]] = score, -(-low * score // 100)
            filled[n] += 1
        others = data.mapInArrow(_negatives(row, own, x, bottom, top, negatives), _PAIRS_SQL)
        done = _sorted_by_anchor(best.unionByName(others)).mapInArrow(_open_windows(low, negatives), "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        ids = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
        found.append(write_scratch(done.join(ids, "anchor").drop("anchor"), "negatives-found"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not found:
        return spark.createDataFrame([], ", ".join(f"{c} {'int' if c == 'rank' else 'long'}" for c in columns))
    return spark.read.parquet(*found).select(*columns)
