"""SimHash near-duplicate groups by pigeonhole blocks.

A document's fingerprint has one bit per bit position of its shingles' hashes,
set where more than half of the shingles set it.  Two fingerprints that differ
in at most ``max_bits`` of 64 bits leave at least ``blocks - max_bits`` of
``blocks`` bit blocks untouched, so they agree on at least one combination of
that many blocks.  Rows are joined on those combinations and each candidate
pair's Hamming distance is verified.

Scale: documents with one fingerprint collapse to one row first, so a group of
exact copies costs one row.  A bucket (fingerprints that agree on a
combination) never yields all its pairs: each cell returns a spanning forest
of its verified links, at most one link a fingerprint, which keeps the
connected components the same.  Buckets above ``cell_rows`` are cut into chunks, and
every pair of chunks is a cell of its own, so no task holds a whole large
bucket and no pair is missed.  More blocks make longer keys: with b blocks
there are C(b, max_bits) keys of about 64 * (b - max_bits) / b bits.

Nulls and ties: a null or word-less text has fingerprint zero and is linked
like any other; null document ids never name a component unless all ids of it are
null; repeated rows share one component.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import free_name, prepare, row_hash
from marketml.session import materialize

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashed), 65536):
        part = np.array(hashed[lo : lo + 65536], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * total > len(hashed), bitorder="little").tobytes(), "little")


def fingerprint_column(text, shingle: int = 4):
    """Column of signed 64-bit fingerprints for a string column."""

    @F.arrow_udf(T.LongType())
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return udf(text)


def _block_masks(blocks: int, max_bits: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks that stay equal."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cut, cut[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints at most ``max_bits``
    apart, by breadth-first search: each visited one is compared with those
    not yet reached, and only the link that first reaches one is kept."""
    links: list[tuple[int, int]] = []
    left = np.unique(fps)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found = left[near]
                links.extend((int(at), int(x)) for x in found)
                queue.extend(found)
                left = left[~near]
    return links


def _cell_links(max_bits: int):
    """Reads rows sorted by cell, one cell after another, in bounded memory."""

    def emit(cells: np.ndarray, fps: np.ndarray):
        edges = np.flatnonzero(np.any(cells[1:] != cells[:-1], axis=1)) + 1
        starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(fps)]))
        size = stops - starts
        two = starts[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits
        a, b = [fps[two[near]]], [fps[two[near] + 1]]
        for s, e in zip(starts[size > 2], stops[size > 2], strict=True):
            if links := _forest(fps[s:e], max_bits):
                pair = np.array(links, np.uint64)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
        u, v = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)[keep]), pa.array(np.maximum(u, v)[keep])], ["u", "v"])

    def run(batches):
        cells, fps = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cells = np.concatenate((cells, new))
            fps = np.concatenate((fps, batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(cells):
                continue
            last = np.flatnonzero(np.any(cells != cells[-1], axis=1))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield emit(cells[:cut], fps[:cut])
                cells, fps = cells[cut:], fps[cut:]
        if len(cells):
            yield emit(cells, fps)

    return run


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, cell_rows: int = 2048) -> DataFrame:
    """Links (u, v), u < v, that connect the distinct values of column ``fp``
    exactly as all pairs at most ``max_bits`` apart would."""
    masks = _block_masks(blocks, max_bits)
    keyed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("int").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)
    ])).alias("b")).select("fp", "b.c", "b.k")
    size = keyed.groupBy("c", "k").count().where("count > 1").select("c", "k", F.ceil(F.col("count") * 2 / cell_rows).cast("int").alias("chunks"))
    rows = keyed.join(size, ["c", "k"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A small bucket is one cell; a large one has a cell for each pair of its chunks.
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (j != F.col("own")) | (F.col("chunks") == 1))
    cells = rows.select("c", "k", "own", F.explode(others).alias("other"), "fp").select(
        "c", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    found = cells.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j", "fp")
    return found.mapInArrow(_cell_links(max_bits), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (u, v) as (node, root), root the smallest
    node, by alternating large-star and small-star rounds.  Each round is a
    grouped minimum and a join; its result is written to the shared folder."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), "cc")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicate_groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 6, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has (doc_id, fp, row) for every input row; groups
    maps each distinct fp to its component's smallest doc_id and the ``row``
    hash that goes with it."""
    prepare(docs.sparkSession)
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), shingle).alias("fp"), row_hash(docs).alias("row")), "simhash")
    # Null ids sort last, so that they name a component only when it has no other.
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = materialize(rows.groupBy("fp").agg(F.min(key).alias("best")), "simhash-fp")
    roots = components(links(best.select("fp"), max_bits, blocks))
    joined = best.join(roots, best.fp == roots.node, "left").select("fp", "best", "root")
    linked = joined.where("root is not null").unionByName(joined.join(roots.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", "best", F.col("fp").alias("root")))
    group = linked.groupBy("root").agg(F.min("best").alias("top"))
    # Fingerprints outside every link stand for themselves.
    named = joined.withColumn("root", F.coalesce("root", "fp")).join(group, "root", "left").select("fp", F.coalesce("top", "best").alias("best"))
    return rows, materialize(named.select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("row")), "simhash-groups")


def assign_components(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows, groups = near_duplicate_groups(docs, **how)
    return rows.join(groups.select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component; one row
    of those that repeat it."""
    _, groups = near_duplicate_groups(docs, doc_id=doc_id, **how)
    own_row, own_id = free_name(docs, "own_row"), free_name(docs, "own_id")
    kept = groups.select(F.col("component_id").alias("kept_id"), F.col("row").alias("kept_row")).distinct()
    rows = docs.withColumn(own_row, row_hash(docs)).withColumn(own_id, F.col(doc_id))
    kept = kept.toDF(free_name(rows, "kept_id"), free_name(rows, "kept_row"))
    # Same keys as the join, so dropping repeated rows needs no other exchange.
    same = F.col(f"`{own_row}`").eqNullSafe(F.col(f"`{kept.columns[1]}`")) & F.col(f"`{own_id}`").eqNullSafe(F.col(f"`{kept.columns[0]}`"))
    return rows.join(kept, same, "left_semi").dropDuplicates([own_row, own_id]).drop(own_row, own_id)
