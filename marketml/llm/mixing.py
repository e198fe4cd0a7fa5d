"""Mixing sources to target weights.

Each source's documents form one stream of words in a pseudorandom order, packed into blocks
of a fixed length (the last one may be shorter).  The mix is a number of output shards of
block slots.  How many of a shard's slots each source fills is a multinomial draw, conditioned
on every source's total, which its target fixes: the law of draws without putting back.  The
k-th slot that a source fills in the whole mix takes block ``perm(k mod blocks)`` of it, where
``perm`` is a pseudorandom permutation of the block numbers, another one for every round through
them; so no block is used once more before all others are, and none more often than the source's
limit.  Slots and blocks then meet in a join on (source, block).

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, ...; they share all words
by weight, a target stops at ``limit`` times its source's words, and the excess is shared by
weight again until no target is above its limit.

Shards draw without any driver loop or shared state.  A group of shards is given its share of
every source's slots by whole-number proportion.  Within a group a tree halves the shards; each
node splits its counts by a hypergeometric draw whose seed is the node's place, so a task finds
its shards' counts, and the slots drawn before them, on the path from the root.

Scale: a document's row is reduced to (source, words, hash) where it lies; texts are never
shuffled.  These rows are range-partitioned by (source, hash), so a source with a third of
all rows spreads over partitions, and a document's place in its stream is its partition's offset plus a sum
within (partition, source).  Blocks hold spans of documents; a very long document is spread
over its blocks by two narrow explodes.  The join's keys are single blocks, used at most
``limit`` times each.  The driver holds one row a source: at most ``MAX_SOURCES``, else an error
names the number.

Results by case.  A null or word-less text has size 0 and is taken 0 times.  Null is a source of its
own, the last; the empty text is one too.  Repeated rows and rows with null ids are documents of their own; rows
equal in all columns may swap places.  Blocks are words, so one text of any length is no special case.
An empty table gives an empty mix.  The same rows and seed give the same mix under any
partitioning.  Helper columns live beside a struct of the kept columns, so no name of the table clashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketml.llm.common import prepare, row_hash
from marketml.session import materialize

#: Words a block, slots a shard, shards a group, sources, rounds through a source.
BLOCK, SHARD, GROUP, MAX_SOURCES, LIMIT = 64, 4096, 16384, 1 << 16, 3
_WORD = r"[^\x20\x09-\x0D]+"
_WIDE = 1024  # blocks that the first of the two explodes steps over


def n_words(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def share_out(sizes: Sequence[int], weights: Sequence[int], limit: int = LIMIT) -> list[Fraction]:
    """Targets: all words by weight, none above ``limit`` times its size."""
    targets = [Fraction(0)] * len(sizes)
    left = Fraction(sum(sizes))
    # A source stops the earlier, the less it has for its weight.
    order = sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i]))
    weight = sum(weights)
    for i in order:
        targets[i] = min(left * weights[i] / weight, Fraction(limit * sizes[i]))
        left -= targets[i]
        weight -= weights[i]
    return targets


def slots_of(sizes: Sequence[int], targets: Sequence[Fraction], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, slots) of each source: as many slots as blocks of its mean length make its target."""
    blocks = [-(-s // block) for s in sizes]
    slots = [round(t * b / s) if s else 0 for s, b, t in zip(sizes, blocks, targets, strict=True)]
    return np.array(blocks, np.int64), np.array(slots, np.int64)


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size - 1 for each key: a Feistel network on
    the next even number of bits, applied again until it falls inside."""
    sizes, which = np.unique(size, return_inverse=True)
    bits = np.array([max(1, -(-(int(s) - 1).bit_length() // 2)) for s in sizes], np.uint64)[which]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        high, low = out[todo] >> b, out[todo] & m
        for turn in range(6):
            f = (low + k + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            high, low = low, high ^ ((f ^ f >> np.uint64(32)) & m)
        out[todo] = high << b | low
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(first: int, end: int, shards: int, slots: np.ndarray, seed: int, group: int = GROUP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source, slots of each source in all shards before) of the
    shards ``first`` to ``end`` of ``shards``."""

    def split(low: int, high: int, counts: np.ndarray, before: np.ndarray):
        if high <= first or low >= end:
            return
        if high - low == 1:
            yield low, counts, before
            return
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        # The left shards' part of the slots, drawn without putting back.
        part = int(counts.sum()) * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(counts, part, method="marginals")
        yield from split(low, middle, left, before)
        yield from split(middle, high, counts - left, before + left)

    groups = -(-shards // group)
    whole = [int(s) for s in slots]
    for g in range(first // group, -(-end // group)):
        low, high = g * group, min((g + 1) * group, shards)
        dealt = [np.array([s * at // shards for s in whole], np.int64) for at in (low, high)]
        if g < groups:
            yield from split(low, high, dealt[1] - dealt[0], dealt[0])


def _slots(shards: int, names: Sequence[str | None], blocks: np.ndarray, slots: np.ndarray, seed: int):
    """The rows (shard, slot, source number, block) of a range of shards."""
    keys = np.array([xxhash.xxh64_intdigest(b"\x00" if n is None else b"\x01" + n.encode("utf-8", "surrogatepass"), seed) for n in names], np.uint64)

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, counts, before in shard_counts(int(ids.min()), int(ids.max()) + 1, shards, slots, seed):
                source = np.repeat(np.arange(len(counts)), counts)
                k = before[source] + np.arange(len(source)) - (np.cumsum(counts) - counts)[source]
                turn, at = k // blocks[source], k % blocks[source]
                block = permuted(at, blocks[source], keys[source] + turn.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                place = np.random.default_rng([seed, shard]).permutation(len(source))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard, np.int64)), pa.array(place.astype(np.int32)), pa.array(source.astype(np.int32)), pa.array(block)], ["shard", "slot", "source", "block"])

    return run


class Mix:
    """A mix of sources.

    ``documents``: a row for each input row with its ``row`` number, ``size``, source
    number ``source``, place ``start`` in the source's stream, and a struct ``keep``.
    ``sources``: the source's number, ``name``, ``source_size``, ``weight``, ``target``, ``blocks`` and ``slots``.
    ``spans``: the mix itself, ``(shard, slot, source, block, row, start, length)``, where a slot
    is the words ``start`` to ``start + length`` of its rows, in the order of (source place) ``at``.
    """

    def __init__(self, documents: DataFrame, sources: DataFrame, spans: DataFrame):
        self.documents, self.sources, self.spans = documents, sources, spans

    def taken(self) -> DataFrame:
        """Every document with its source and ``taken``, the words that the mix takes of it."""
        used = self.spans.groupBy("row").agg(F.sum("length").alias("taken"))
        docs = self.documents.join(F.broadcast(self.sources), "source").join(used, "row", "left")
        return docs.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", keep: tuple[str, ...] = ("doc_id",), weights: Sequence[int] = (1, 2, 3), block: int = BLOCK, shard: int = SHARD, limit: int = LIMIT, seed: int = 0) -> Mix:
    """Mix the sources of ``docs``; ``weights`` repeat over the sources in code point order."""
    spark = docs.sparkSession
    prepare(spark)
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep])
    rows = docs.select(F.col(f"`{source}`").cast("string").alias("name"), n_words(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.lit(seed), row_hash(docs)).alias("hash"), kept.alias("keep"))
    rows = materialize(rows, "mix-sizes")

    totals = rows.groupBy("name").agg(F.sum("size").alias("size"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: {totals.count()}")
    # Python compares texts by code point.
    found = sorted(found, key=lambda r: (r.name is None, r.name or ""))
    sizes = [r.size for r in found]
    weight = [weights[i % len(weights)] for i in range(len(found))]
    targets = share_out(sizes, weight, limit)
    blocks, slots = slots_of(sizes, targets, block)
    table = [(i, r.name, r.size, w, float(t), int(b), int(q)) for i, (r, w, t, b, q) in enumerate(zip(found, weight, targets, blocks, slots, strict=True))]
    sources = spark.createDataFrame(table, "source int, name string, source_size long, weight int, target double, blocks long, slots long")

    numbered = rows.join(F.broadcast(sources.select("source", F.col("name").alias("n"))), F.col("name").eqNullSafe(F.col("n"))).select("source", "size", "hash", "keep")
    # The last range key parts equal rows, so a group of copies spreads over partitions.
    placed = numbered.withColumn("n", F.monotonically_increasing_id()).repartitionByRange("source", "hash", "n").sortWithinPartitions("source", "hash", "n")
    documents = materialize(placed.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"), "source", "size", "keep"), "mix-documents")
    offsets = documents.groupBy("part", "source").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(offsets.select("part", "source", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("offset")), "mix-offsets")
    within = Window.partitionBy("part", "source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    documents = documents.join(offsets, ["part", "source"]).select("row", "source", "size", (F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start"), "keep")
    documents = materialize(documents, "mix-starts")

    # Each document's words, cut at the blocks' borders.
    held = documents.where("size > 0").select("row", "source", "size", F.col("start").alias("at"), F.expr(f"start div {block}").alias("first"), F.expr(f"(start + size - 1) div {block}").alias("last"))
    wide = held.withColumn("far", F.explode(F.sequence("first", "last", F.lit(_WIDE).cast("long"))))
    pieces = wide.withColumn("block", F.explode(F.sequence("far", F.least(F.col("far") + (_WIDE - 1), F.col("last")))))
    begin = F.greatest(F.col("block") * block, F.col("at"))
    end = F.least((F.col("block") + 1) * block, F.col("at") + F.col("size"))
    pieces = pieces.select("source", "block", "row", begin.alias("at"), (begin - F.col("at")).alias("start"), (end - begin).alias("length"))

    shards = -(-int(slots.sum()) // shard)
    drawn = spark.range(shards).mapInArrow(_slots(shards, [r.name for r in found], blocks, slots, seed), "shard long, slot int, source int, block long")
    spans = drawn.join(pieces.hint("merge"), ["source", "block"]).select("shard", "slot", "source", "block", "row", "at", "start", "length")
    return Mix(documents, sources, materialize(spans, "mix-spans"))


def render(mix: Mix, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(shard, slot, text): each slot's words in order, a space between two.  ``key`` is a
    kept column that names the documents of ``docs`` uniquely."""
    rows = mix.documents.select("row", F.col("keep").getField(key).alias("key"))
    words = docs.select(F.col(f"`{key}`").alias("key"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({_WORD})")).alias("words"))
    pieces = mix.spans.join(rows.join(words, "key"), "row")
    pieces = pieces.select("shard", "slot", "at", F.slice("words", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("words"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "words")))  # at most a block of words
    return pieces.groupBy("shard", "slot").agg(F.array_join(F.flatten(F.transform(ordered, lambda p: p["words"])), " ").alias("text"))
