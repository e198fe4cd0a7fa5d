"""Train/test splits and fold assignment (M2, M3).

The default split is a hash of an integer row key, so it is the same on any
partitioning, in any engine, and needs no shuffle (it is a filter).  The
reference's ``randomSplit`` is kept for parity; it depends on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed hash parameters (odd multipliers, prime modulus) shared with the SQL
# oracles, so both engines assign every row to the same side and fold.
SPLIT_MULT = 2654435761
FOLD_MULT = 2246822519
HASH_MOD = 1000003


def market_key(region_col: str = "region_id", period_col: str = "period_begin") -> Column:
    """Integer key of a market row: region * 100000 + days since epoch."""
    return (F.col(region_col).cast("long") * 100000
            + F.datediff(F.col(period_col), F.lit("1970-01-01").cast("date")).cast("long"))


def hash_bucket(key: Column, buckets: int, mult: int = SPLIT_MULT) -> Column:
    """``(key * mult) % 1000003 % buckets`` as int, for a non-negative key.

    The key is reduced modulo 1000003 before the multiplication, which gives
    the same bucket (modular arithmetic) and keeps the product far below
    the long range for any key size."""
    mod = F.lit(HASH_MOD).cast("long")
    reduced = F.pmod(key.cast("long"), mod)
    return (F.pmod(reduced * F.lit(mult).cast("long"), mod) % buckets).cast("int")


def with_split(df: DataFrame, key: Column, train_pct: int = 80, col: str = "split") -> DataFrame:
    """Tag rows ``train``/``test``: hash bucket in [0, 100) below ``train_pct``."""
    return df.withColumn(
        col, F.when(hash_bucket(key, 100) < train_pct, F.lit("train")).otherwise(F.lit("test")))


def hash_split(df: DataFrame, key: Column, train_pct: int = 80) -> tuple[DataFrame, DataFrame]:
    """Deterministic (train, test) pair, each a plain filter."""
    b = hash_bucket(key, 100)
    return df.where(b < train_pct), df.where(b >= train_pct)


def random_split(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), seed: int = 42):
    """The reference's split: ``randomSplit`` (depends on partitioning)."""
    return df.randomSplit(list(weights), seed=seed)


def with_fold(df: DataFrame, key: Column, k: int, col: str = "fold") -> DataFrame:
    """Fold number in [0, k) from a second hash of the key."""
    return df.withColumn(col, hash_bucket(key, k, FOLD_MULT))


def with_validation(df: DataFrame, key: Column, train_ratio: float = 0.8,
                    col: str = "is_validation") -> DataFrame:
    """Deterministic train/validation flag for train-validation tuning."""
    cut = int(round(train_ratio * 100))
    return df.withColumn(col, hash_bucket(key, 100, FOLD_MULT) >= cut)


def split_counts(df: DataFrame, col: str = "split") -> DataFrame:
    """Rows per split value (M3): ``(split, n)``."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
