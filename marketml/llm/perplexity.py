"""Quality rules with an n-gram perplexity band for each language.

The model is a modified Kneser-Ney model over the symbols of a text, one for each
language.  A symbol is a UTF-16 unit: every character of the basic plane is one of its own, and
the others are two, so no characters are merged and four symbols fill a 64-bit code.  Spark counts every document's n-grams; the
lower orders' continuation counts, the discounts from the counts of counts, the
interpolation weights and the probabilities follow by grouped aggregation and joins.

``judge`` scores the documents that it counted, so every n-gram has a probability of its own.  The most
frequent ones lie in sorted arrays of 64-bit hashes, which every task searches; what these do not hold is
joined, so no n-gram is left out or approximated.  ``build_model`` stores all orders in arrays of a fixed
size instead, to score other texts.

A text's perplexity is per word, as usual: the n-grams' log probabilities,
divided by the words that have a letter or digit, so marks hung on words and
columns of marks raise it.  A document passes if it has enough words, does not repeat
itself, and its log perplexity lies inside its language's band, which reaches ``width``
interquartile ranges beyond the quartiles of that language's documents.

Scale: counting combines each task's n-grams before one shuffle of (language,
n-gram, count); a frequent n-gram is one row a task.  ``judge`` broadcasts at most about 2 **
``hash_bits`` n-grams of 16 bytes, 67 MB at 22 bits, whatever the corpus (and once in each Python
worker).  Rarer ones are met seldom: the texts' n-grams that the arrays lack are joined with the
distributed table of the rest by (language, n-gram), and their sums go back to the rows by an id.  An order of ``build_model`` has 2 **
``hash_bits`` slots for probabilities and for back-off weights, 10 bytes each.  Where n-grams share a slot it holds the most frequent one and, beside its value, a mark of
16 more bits of its hash: the others, like n-grams never seen, miss the mark and back off.  Bands come from
counts of score bins, at most a few thousand a language.

Nulls and ties: a null or empty text has no words, fails the base rules and has
a null perplexity; a null language is a language of its own ("und"); repeated rows count
as often as they occur and get the same verdict; a language none of whose documents
passes the base rules has no band and rejects nothing by perplexity.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import give_back, prepare
from marketml.session import materialize

ORDER = 4
HASH_BITS = 22
WIDTH = 6.0
BIN = 0.01
_BITS = 16
#: The share of a symbol that no count has seen: a fixed value.
_UNIFORM = -float(np.log(1 << 12))
MARKS = "#*$%&|<>"
#: ASCII other than letters and digits parts the words that perplexity counts.
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SPACE = " \t\n\r\x0b\x0c"


def symbols(text: str) -> np.ndarray:
    """The UTF-16 units of a text; 0 is left for the text's start, and U+0000 takes
    the place of U+FFFF, which is no character."""
    at = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int64)
    return np.where(at > 0, at, 0xFFFF)


def _before(code: np.ndarray) -> np.ndarray:
    """The context of each n-gram; codes of four symbols use the sign bit too."""
    return (code.view(np.uint64) >> np.uint64(_BITS)).view(np.int64)


def grams(texts: list[str], order: int) -> np.ndarray:
    """Codes of every n-gram that ends at a character of the texts; the
    first ones reach back over the text's start.  At most four symbols fit in a code."""
    if order * _BITS > 64:
        raise ValueError("order must be at most 4")
    pad = np.zeros(order - 1, np.int64)
    line = np.concatenate([x for t in texts if t for x in (pad, symbols(t))] or [pad])
    code = np.zeros(max(0, len(line) - order + 1), np.int64)
    for k in range(order):
        code <<= _BITS
        code |= line[k : k + len(code)]
    return code[line[order - 1 :] > 0]


def _hash(code: np.ndarray, salt: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit mix of each n-gram; those of one salt and order never share one."""
    with np.errstate(over="ignore"):
        h = (code.astype(np.uint64) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15) ^ salt.astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _mix(code: np.ndarray, salt: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The key of each n-gram: the top ``bits`` of its hash are its slot, the 16 lowest its mark."""
    h = _hash(code, salt, order)
    return (h >> np.uint64(64 - bits) << np.uint64(16) | h & np.uint64(0xFFFF)).astype(np.int64)


def _key(salt, code, order: int, bits: int | None = None):
    """Column of the keys for ``bits``, or of the whole hashes."""

    @F.arrow_udf(T.LongType())
    def udf(salts: pa.Array, codes: pa.Array) -> pa.Array:
        at = codes.to_numpy(zero_copy_only=False), salts.to_numpy(zero_copy_only=False), order
        return pa.array(_hash(*at).view(np.int64) if bits is None else _mix(*at, bits))

    return udf(salt, code)


def count_grams(docs: DataFrame, order: int = ORDER, text: str = "text", lang: str = "lang", hold: int = 4_000_000) -> DataFrame:
    """(lang, code, n): how often each n-gram of the highest order occurs.  A
    task adds up its own n-grams, and passes them on when it holds ``hold``."""

    def run(batches):
        give_back()
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for name, (codes, n) in held.items():
                for lo in range(0, len(codes), 200_000):
                    part = codes[lo : lo + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[lo : lo + 200_000])], ["lang", "code", "n"])
            held.clear()

        for b in batches:
            texts: dict[str, list[str]] = {}
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(name, []).append(t or "")
            for name, group in texts.items():
                codes, n = np.unique(grams(group, order), return_counts=True)
                if name in held:
                    codes, at = np.unique(np.concatenate((held[name][0], codes)), return_inverse=True)
                    n = np.bincount(at, np.concatenate((held[name][1], n)), len(codes)).astype(np.int64)
                held[name] = codes, n
            if sum(len(c) for c, _ in held.values()) > hold:
                yield from out()
        yield from out()

    rows = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts.  Where one is missing
    (a small corpus), the discounts are 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4))
    seen = table.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    least = lambda c, k: F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), c))
    ratio = lambda k: k - (k + 1) * y * F.when(whole, F.col(f"n{k + 1}") / F.col(f"n{k}"))
    return seen.select("lang", *[F.when(whole, least(ratio(k), k)).otherwise(k / 2).alias(f"d{k}") for k in (1, 2, 3)])


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(probabilities, backoffs) of the model: (k, lang, code, n, logp) for the n-grams
    of every order k, and (k, lang, code, n, bow) for their contexts."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        # A lower order counts the different symbols seen before an n-gram.
        tables[k] = materialize(tables[k + 1].select("lang", F.col("code").bitwiseAND((1 << _BITS * k) - 1).alias("code")).groupBy("lang", "code").agg(F.count("*").alias("n")), "kn-counts")
    below, probs, bows = None, [], []
    for k in range(1, order + 1):
        t = tables[k].join(materialize(_discounts(tables[k]), "kn-discounts"), "lang").withColumn("ctx", F.shiftrightunsigned("code", _BITS))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.withColumn("d", d)
        ctx = t.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("bow"))
        t = t.join(ctx, ["lang", "ctx"]).withColumn("own", (F.col("n") - F.col("d")) / F.col("total"))
        if k == 1:
            p = F.col("own") + F.col("bow") * float(np.exp(_UNIFORM))
        else:
            t = t.withColumn("low", F.col("code").bitwiseAND((1 << _BITS * (k - 1)) - 1)).join(below, ["lang", "low"])
            p = F.col("own") + F.col("bow") * F.col("p")
        t = materialize(t.select("lang", "code", "n", p.alias("p_new"), "ctx", "total", F.log("bow").alias("bow")), "kn-probs")
        below = t.select("lang", F.col("code").alias("low"), F.col("p_new").alias("p"))
        probs.append(t.select(F.lit(k).alias("k"), "lang", "code", "n", F.log("p_new").alias("logp")))
        bows.append(t.select(F.lit(k).alias("k"), "lang", F.col("ctx").alias("code"), F.col("total").alias("n"), "bow").distinct())
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(probs), union(bows)


class HashArrays:
    """Sorted slots of each order's n-grams with their marks and values.  An n-gram whose mark differs
    from its slot's is one that was not counted."""

    def __init__(self, order: int, bits: int, probs: dict, bows: dict):
        self.order, self.bits, self.probs, self.bows = order, bits, probs, bows

    @staticmethod
    def _find(table, keys):
        slots, marks, values = table
        if not len(slots):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        slot = (keys >> 16).astype(np.int32)
        at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
        return (slots[at] == slot) & (marks[at] == keys & 0xFFFF), values[at]

    def log_probs(self, codes: np.ndarray, salt: int) -> np.ndarray:
        """Log probability of each highest-order n-gram, backing off to the
        longest suffix that was counted."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        salts = np.full(len(codes), salt, np.int64)
        for k in range(self.order, 0, -1):
            hit, value = self._find(self.probs[k], _mix(codes, salts, k, self.bits))
            out[open_[hit]] += value[hit]
            codes, open_, salts = codes[~hit], open_[~hit], salts[~hit]
            if not len(codes):
                return out
            hit, value = self._find(self.bows[k], _mix(_before(codes), salts, k, self.bits))
            out[open_[hit]] += value[hit]
            codes = codes & ((1 << _BITS * (k - 1)) - 1)
        out[open_] += _UNIFORM
        return out


def build_model(docs: DataFrame, order: int = ORDER, hash_bits: int = HASH_BITS, text: str = "text", lang: str = "lang") -> HashArrays:
    """Counts all of ``docs`` and stores the model in sorted hash arrays."""
    prepare(docs.sparkSession)
    probs, bows = kneser_ney(materialize(count_grams(docs, order, text, lang), "kn-counts"), order)
    out = []
    for table, value in ((probs, "logp"), (bows, "bow")):
        salted = table.withColumn("salt", F.xxhash64("lang"))
        keyed = reduce(DataFrame.unionByName, [salted.where(F.col("k") == k).select("k", _key(F.col("salt"), F.col("code"), k, hash_bits).alias("key"), "n", "code", F.col(value).alias("v")) for k in range(1, order + 1)])
        # Bounded: at most 2 ** hash_bits rows an order.
        best = keyed.groupBy("k", F.shiftright("key", 16).alias("slot")).agg(F.max(F.struct("n", "code", "key", "v")).alias("m")).select("k", "m.key", F.col("m.v").cast("float").alias("v")).toArrow()
        k, key, v = (best.column(i).to_numpy() for i in range(3))
        arrays = {}
        for n in range(1, order + 1):
            mine = np.flatnonzero(k == n)
            mine = mine[np.argsort(key[mine])]
            arrays[n] = (key[mine] >> 16).astype(np.int32), (key[mine] & 0xFFFF).astype(np.uint16), v[mine]
        out.append(arrays)
    return HashArrays(order, hash_bits, *out)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    marks = sum(map(text.count, MARKS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeat = 0
    if n > 3:
        ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        # Two steps keep the number of a window below n * n.
        _, two = np.unique(a[:-1] * n + a[1:], return_inverse=True)
        _, at, count = np.unique(two[:-1] * n + a[2:], return_inverse=True, return_counts=True)
        often = count[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= often
        repeat = int(covered.sum())
    return n, chars, marks, len(lines) - len(set(lines)), repeat


def held_and_rest(docs: DataFrame, order: int = ORDER, hash_bits: int = HASH_BITS, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Log probabilities of all n-grams of the highest order in ``docs``: the sorted hashes and the values of
    the most frequent ones, about 2 ** ``hash_bits`` at most, and (lang, code, logp) of the others, None if there are none."""
    prepare(docs.sparkSession)
    probs, _ = kneser_ney(materialize(count_grams(docs, order, text, lang), "kn-counts"), order)
    top = probs.where(F.col("k") == order).select("lang", "code", "n", "logp", _key(F.xxhash64("lang"), F.col("code"), order).alias("key"))
    top = materialize(top, "kn-top")
    total, least = top.count(), 0
    if total > 1 << hash_bits:
        least = top.agg(F.percentile_approx("n", 1 - (1 << hash_bits) / total)).first()[0] + 1
    # Two languages' n-grams with one hash are told apart by the join alone.
    held = top.groupBy("key").agg(F.count("*").alias("same"), F.max("n").alias("n"), F.max("logp").alias("logp"))
    held = materialize(held.where((F.col("same") == 1) & (F.col("n") >= least)).select("key", "logp"), "kn-held")
    # Bounded: about 2 ** hash_bits rows.
    key, value = (c.to_numpy() for c in held.toArrow().columns)
    place = np.argsort(key)
    rest = materialize(top.join(held, "key", "left_anti").select("lang", "code", "logp"), "kn-rest") if len(key) < total else None
    return key[place], value[place], rest


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "divisor")
SCORES = T.StructType([*[T.StructField(n, T.LongType()) for n in _LONGS], T.StructField("log_sum", T.DoubleType()),
                       T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))])


def scores_column(shared, text, salt, order: int):
    """Struct of the base counts, the words that perplexity counts, the log probability of the n-grams that
    the arrays hold (null for an empty text), and the other n-grams with how often they occur."""

    @F.arrow_udf(SCORES)
    def udf(texts: pa.Array, salts: pa.Array) -> pa.Array:
        keys, values = shared.value
        rows, codes, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, s in zip(texts.to_pylist(), salts.to_pylist(), strict=True):
            t, log, lacks = t or "", None, 0
            if t:
                code, n = np.unique(grams([t], order), return_counts=True)
                h = _hash(code, np.full(len(code), s, np.int64), order).view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                log, lacks = float(np.dot(values[at[hit]], n[hit])), int(len(h) - hit.sum())
                if lacks:
                    codes.append(code[~hit])
                    times.append(n[~hit])
            rows.append((*base_counts(t), max(1, len(t.encode().translate(_APART).split())), log, lacks))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        ends = np.cumsum([0, *columns[7]], dtype=np.int32)
        lists = [pa.ListArray.from_arrays(ends, np.concatenate(x).astype(np.int64)) for x in (codes, times)]
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.float64()), *lists], names=SCORES.names)

    return udf(text, salt)


def bands(scored: DataFrame, width: float = WIDTH) -> DataFrame:
    """(lang, low, high) of the log perplexity, over the documents of ``scored`` that
    pass the base rules."""
    bins = scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull()).groupBy("lang", F.floor(F.col("log_perplexity") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    ranked = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    q = ranked.groupBy("lang").agg(*[F.min(F.when(F.col("upto") >= F.col("total") * p, (F.col("bin") + 0.5) * BIN)).alias(n) for n, p in (("a", 0.25), ("b", 0.75))])
    # A narrow language still gets a tolerance of some bins.
    reach = width * F.greatest(F.col("b") - F.col("a"), F.lit(10 * BIN))
    return q.select("lang", (F.col("a") - reach).alias("low"), (F.col("b") + reach).alias("high"))


def judge(docs: DataFrame, order: int = ORDER, hash_bits: int = HASH_BITS, width: float = WIDTH, min_words: int = 50, max_repeat_pct: int = 50, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang, the five base counts, log_perplexity,
    base_failed, low, high and kept for every row."""
    spark = docs.sparkSession
    prepare(spark)
    keys, values, rest = held_and_rest(docs, order, hash_bits, text, lang)
    shared = spark.sparkContext.broadcast((keys, values))
    name = F.coalesce(F.col(lang), F.lit("und"))
    scored = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], name.alias("lang"), scores_column(shared, F.col(text), F.xxhash64(name), order).alias("s"))
    wide = [*[f"keep_{c}" for c in keep], "lang", *[f"s.{c}" for c in _LONGS], "s.log_sum"]
    log_sum = F.col("log_sum")
    if rest is None:
        scored = materialize(scored.select(*wide), "perplexity")
    else:
        scored = materialize(scored.select(*wide, "s.codes", "s.times", F.monotonically_increasing_id().alias("row")), "perplexity")
        lacking = scored.select("row", "lang", F.explode(F.arrays_zip("codes", "times")).alias("g")).select("row", "lang", F.col("g.codes").alias("code"), F.col("g.times").alias("n"))
        added = lacking.join(rest, ["lang", "code"]).groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("more"))
        scored = scored.drop("codes", "times").join(materialize(added, "perplexity-rest"), "row", "left")
        log_sum = log_sum + F.coalesce("more", F.lit(0.0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    log = F.round(-log_sum / F.col("divisor"), 9)
    scored = scored.select(*[f"keep_{c}" for c in keep], "lang", *_LONGS[:5], log.alias("log_perplexity"), failed.alias("base_failed"))
    if rest is not None:
        scored = materialize(scored, "perplexity-all")
    # Written first, so the join knows its few bytes and does not gather a frequent language in one task.
    limits = materialize(bands(scored, width), "perplexity-bands")
    x = F.col("log_perplexity")
    inside = F.col("low").isNull() | ((x >= F.col("low")) & (x <= F.col("high")))
    return scored.join(limits, "lang", "left").withColumn("kept", ~F.col("base_failed") & inside)


def keep_good(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged."""
    judged = judge(docs, keep=tuple(docs.columns), **how)
    return judged.where("kept").select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])
