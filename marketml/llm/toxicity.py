"""Toxicity by multiple-instance learning.

Only documents are labelled, but sentences offend.  A sentence's
probability is logistic in its words and their beginnings (so that inflected forms
share a weight); a document's is the noisy-or of its sentences', 1 - prod(1 - p).  The
weights are trained from the document labels through the noisy-or, and the same
sentence probabilities then locate the offending sentences.

Training first counts, in Spark, in how many documents of either label each
hashed feature occurs, and keeps the ``features`` with the largest chi-square.  Then it
descends the noisy-or loss by full-batch gradients (Adam).  Each step is one Spark job
over the kept features of the sentences, which are written once to the shared folder;
a task returns the summed gradient of its rows.  At most about ``max_train_docs``
labelled documents are used, those with the smallest hash of their id; every
document is scored.

Nulls and ties: a null or empty text has no sentences and scores 0; a null label is
no label; repeated labels count as often as they occur; features with equal chi-square
rank by their slot; without both labels among the training rows every score is 0.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.llm.common import prepare
from marketml.session import materialize

HASH_BITS = 18
FEATURES = 512
MAX_TRAIN_DOCS = 20_000
STEPS = 80
RATE = 0.2
RIDGE = 1e-4
#: Bytes of a word's beginnings that are features of their own.
PREFIXES = range(3, 9)
_SENTENCE = re.compile(rb"[.!?\n]+")
#: ASCII outside letters and digits parts words, A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))
_KEEP = bytes(c if c in b".!?\n" else _TABLE[c] for c in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [w for w in (s.split() for s in _SENTENCE.split((text or "").encode().translate(_KEEP))) if w]


def word_slots(word: bytes, bits: int) -> list[int]:
    """Hash slots of a word and of its beginnings."""
    keep = 32 - bits
    return [zlib.crc32(word + b" ") >> keep, *(zlib.crc32(word[:k]) >> keep for k in PREFIXES if k < len(word))]


class Model:
    """Weights of the kept slots and a bias; ``idle`` if there was nothing to learn."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, bias: float, bits: int, idle: bool = False):
        self.slots, self.weights, self.bias, self.bits, self.idle = slots, weights, bias, bits, idle

    def scorer(self):
        return _Words(dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True)), self.bits)

    def sentence_probs(self, text: str | None, words: _Words) -> np.ndarray:
        parts = sentences(text)
        if self.idle:
            return np.zeros(len(parts))
        total = np.fromiter((sum(map(words.__getitem__, p)) for p in parts), float, len(parts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


class _Words(dict):
    """The weight of each word met, at most ``most`` at a time."""

    def __init__(self, weights: dict, bits: int, most: int = 500_000):
        super().__init__()
        self.of, self.bits, self.most = weights, bits, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        get = self.of.get
        w = self[word] = sum(get(s, 0.0) for s in word_slots(word, self.bits))
        return w


def noisy_or(probs: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(probs, 1 - 1e-12)).sum()))


def _document_counts(bits: int):
    """Per task: in how many documents of each label every slot occurs."""

    def run(batches):
        counts = np.zeros((2, 1 << bits), np.int64)
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {w for p in sentences(text) for w in p}
                slots = np.array(list({s for w in words for s in word_slots(w, bits)}), np.int64)
                counts[y][slots] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[1][at]), pa.array(counts[0][at])], ["slot", "a", "c"])

    return run


def _kept_sentences(slots: np.ndarray, bits: int):
    """Per document: the kept features of its sentences, where each such
    sentence starts among them, and the number of sentences without any."""
    index = {s: i for i, s in enumerate(slots.tolist())}

    def run(batches):
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                parts = [[index[s] for w in p for s in word_slots(w, bits) if s in index] for p in sentences(text)]
                some = [p for p in parts if p]
                found.append(([f for p in some for f in p], np.cumsum([0, *map(len, some[:-1])]).tolist() if some else [], len(parts) - len(some)))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)] + [b.column(1)], ["words", "starts", "plain", "y"])

    return run


def _gradient(shared):
    """Per task: the summed loss and gradients of the bias and of the weights."""

    def run(batches):
        w, bias = shared.value
        grad, bias_grad, loss = np.zeros(len(w)), 0.0, 0.0
        p0 = 1 / (1 + np.exp(-bias))
        for b in batches:
            if not b.num_rows:
                continue
            per_doc = np.diff(b.column(1).offsets.to_numpy())
            at = b.column(0).offsets.to_numpy()
            first = b.column(1).flatten().to_numpy() + np.repeat(at[:-1] - at[0], per_doc)
            words, plain, y = b.column(0).flatten().to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            none, doc = plain * np.log1p(-p0), np.repeat(np.arange(len(y)), per_doc)
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[words], first) + bias, -30, 30))) if len(first) else np.zeros(0)
            none += np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
            q = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
            # d loss / d z of a sentence: p for a clean document, p - p / q for a toxic one.
            f = np.where(y == 1, 1 - 1 / q, 1.0)
            g = p * f[doc]
            loss -= np.where(y == 1, np.log(q), np.log1p(-q)).sum()
            bias_grad += g.sum() + (p0 * f * plain).sum()
            if len(first):
                grad += np.bincount(words, np.repeat(g, np.diff(np.append(first, len(words)))), len(grad))
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([bias_grad]), pa.array([grad.tolist()], pa.list_(pa.float64()))], ["loss", "bias", "grad"])

    return run


def train(docs: DataFrame, labels: DataFrame, hash_bits: int = HASH_BITS, features: int = FEATURES, max_train_docs: int = MAX_TRAIN_DOCS, steps: int = STEPS, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """The model of the labelled documents.  ``labels`` has doc_id and label."""
    spark = docs.sparkSession
    prepare(spark)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    total = rows.count()
    if total > max_train_docs:  # the documented bound of the training sample
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int((1 << 40) * max_train_docs / total))
    sample = materialize(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(rows, "id").select("text", "y"), "mil-sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, hash_bits, idle=True)
    a, c, b, d = F.col("a"), F.col("c"), toxic - F.col("a"), (n - toxic) - F.col("c")
    seen = sample.mapInArrow(_document_counts(hash_bits), "slot int, a long, c long").groupBy("slot").agg(F.sum("a").cast("double").alias("a"), F.sum("c").cast("double").alias("c"))
    chi = n * F.pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d))
    best = seen.where("a + c >= 3").where(F.col("a") + F.col("c") < n).withColumn("chi", chi).orderBy(F.desc("chi"), "slot").limit(features).collect()
    slots = np.array([r["slot"] for r in best], np.int64)
    data = materialize(sample.mapInArrow(_kept_sentences(slots, hash_bits), "words array<int>, starts array<int>, plain long, y int"), "mil")
    size = len(slots)
    w = np.append(np.zeros(size), -5.0)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        shared = spark.sparkContext.broadcast((w[:size], w[size]))
        parts = data.mapInArrow(_gradient(shared), "loss double, bias double, grad array<double>").collect()
        shared.unpersist()
        g = sum(np.append(p["grad"], p["bias"]) for p in parts) / n + RIDGE * np.append(w[:size], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
    return Model(slots, w[:size], w[size], hash_bits)


FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("worst", T.ArrayType(T.StructType([T.StructField("sentence", T.IntegerType()), T.StructField("p", T.DoubleType())])))])


def score(docs: DataFrame, model: Model, at: float = 0.5, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``into``: the document's ``score`` and its ``worst``
    sentences (number among the text's sentences, probability) of at least ``at``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    state: dict = {}  # a task's word weights, kept from batch to batch

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        out, words = [], state.get("words")
        if words is None:
            words = state["words"] = shared.value.scorer()
        for t in texts.to_pylist():
            p = shared.value.sentence_probs(t, words)
            out.append({"score": round(noisy_or(p), 9), "worst": [{"sentence": int(i), "p": float(p[i])} for i in np.flatnonzero(p >= at)]})
        return pa.array(out, pa.struct([("score", pa.float64()), ("worst", pa.list_(pa.struct([("sentence", pa.int32()), ("p", pa.float64())])))]))

    return docs.withColumn(into, found(F.col(text)))
