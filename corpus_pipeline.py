"""Corpus pipeline: documents to packed training sequences.

Each stage takes the rows that its predecessor kept, and its result is written
as Parquet in the shared checkpoint folder and read again, so a lost executor or
a stage that fails costs no earlier work.

1. quality rules: documents that fail the base rules or lie outside their
   language's perplexity band go.
2. SimHash near-dedup: the document with the smallest id of each component stays.
3. benchmark decontamination: contaminated documents go.
4. secret scans: reported spans are replaced by their kind in brackets, and n_chars counts the new text.
5. packing: one row for each piece of a document, with its token ids.

Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketml.llm import credentials, decontaminate, packing, perplexity, simhash
from marketml.llm.common import prepare, read
from marketml.llm.queries import tokenizer_path
from marketml.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return perplexity.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"), window=13)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return credentials.redact(docs, scope=256, length="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Executors still hold memory of the earlier stages, so workers remember fewer parts of texts, and nothing once
    # a task has ended: they go on to other stages.
    return packing.pack(docs, tokenizer_path(), tokens=2048, cached=150_000, kept=False)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: The perplexity model, the fingerprints and the tokenizer have no SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
