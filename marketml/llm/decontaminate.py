"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of every benchmark item (a shorter item is
one pattern).  Patterns of one length form one search: a shift table gives, for
each block of two words, how far the search may move when that block ends at
the present position; blocks that occur in no pattern move it past every
possible start.  Where the shift is zero, the block selects the bucket of
patterns that end with it, and the words are compared directly.

Scale: documents are scanned where they lie, with no shuffle.  The patterns
travel to the tasks in shards of about ``shard_words`` words, so what is
broadcast at once has a fixed bound whatever the benchmark's size.  Each
further shard is another pass: what the earlier ones found is written first, and
their patterns are taken back from the executors.

Nulls and ties: a null or empty text has no words and is not contaminated; an item
without words has no pattern; an item with a null id still marks words but is not
listed; items that share an id count once.  With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import free_name, prepare
from marketml.session import materialize

WINDOW = 13
SHARD_WORDS = 2_000_000
#: A-Z become a-z, other ASCII outside 0-9 and a-z parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Searches:
    """Shift tables and suffix buckets, one search for each pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        patterns: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                patterns.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(item)
        self.searches = []
        for size, found in sorted(patterns.items()):
            block = min(2, size)
            shift: dict = {}
            buckets: dict = {}
            for p, ids in found.items():
                for end in range(block, size + 1):
                    b = p[end - block : end]
                    shift[b] = min(shift.get(b, size), size - end)
                buckets.setdefault(p[size - block :], {})[p] = ids
            self.searches.append((size, block, shift, buckets))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of all occurrences, merged, and their items."""
        spans, items, n = [], set(), len(words)
        for size, block, shift, buckets in self.searches:
            far, at = size - block + 1, size
            while at <= n:
                b = tuple(words[at - block : at])
                move = shift.get(b, far)
                if move:
                    at += move
                    continue
                ids = buckets[b].get(tuple(words[at - size : at]))
                if ids:
                    spans.append((at - size, at))
                    items |= ids
                at += 1
        return merged(spans), items


def merged(spans):
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan_column(shared, text, before=None):
    """One pass: what ``shared`` finds, joined with what earlier shards found."""

    def found(texts, earlier):
        search, out = shared.value, []
        for i, text in enumerate(texts):
            words = words_of(text)
            spans, items = search.scan(words)
            if earlier is not None:
                spans = merged([*spans, *((s["start"], s["end"]) for s in earlier[i]["spans"])])
                items |= set(earlier[i]["items"])
            out.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(x for x in items if x is not None)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]))

    if before is None:
        @F.arrow_udf(FOUND)
        def first(texts: pa.Array) -> pa.Array:
            return found(texts.to_pylist(), None)

        return first(text)

    @F.arrow_udf(FOUND)
    def further(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        return found(texts.to_pylist(), earlier.to_pylist())

    return further(text, before)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with a column ``into``: struct of n_words, merged word ``spans``
    (end exclusive) covered by benchmark windows, and the sorted ``items`` hit."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).distinct()
    # Long items bound a shard only together with its others; sizes are counted, texts are not read to the driver at once.
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // (2 * shard_words)))
    out, before, shared = docs, None, None
    for shard in range(shards):
        if shared is not None:
            out = materialize(out, "decontaminate")
            shared.unpersist()
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast(Searches([tuple(r) for r in part.toLocalIterator()], window))
        out = out.withColumn(into, _scan_column(shared, F.col(text), before))
        before = F.col(into)
    return out


def contaminated(found: str = "found"):
    """Over a column of ``find_benchmark``: at least a twentieth of the words hit."""
    hit = hit_words(found)
    return (hit > 0) & (20 * hit >= F.col(f"{found}.n_words"))


def hit_words(found: str = "found"):
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    into = free_name(docs, "found")
    return find_benchmark(docs, benchmark, into=into, **how).where(~contaminated(into)).drop(into)
