"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies at the same path
    (local sessions; a cluster ships it with ``--py-files``), and bound the
    rows of one Arrow batch, as documents may be long."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(df: DataFrame, *but: str):
    """A 64-bit hash over every column of a row, to tell apart rows that share
    an id.  Floating, map and nested columns go through their JSON text."""
    plain = ("string", "bigint", "int", "smallint", "tinyint", "boolean", "date", "timestamp", "binary")
    cols = []
    for name, kind in df.dtypes:
        if name in but:
            continue
        col = F.col(f"`{name}`")
        cols.append(col if kind in plain else F.to_json(F.struct(col.alias("v"))))
    return F.xxhash64(*cols, F.lit(len(cols)))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return to the system what earlier tasks of this Python worker have freed but its allocators still hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
