"""Feature vectors (M1, F10, F11) and ablation feature sets (M4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketml.functions.scalar import zip_names


def assembler(features: Sequence[str], output: str = "features",
              handle_invalid: str = "error") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid=handle_invalid)


def assemble(df: DataFrame, features: Sequence[str], output: str = "features",
             handle_invalid: str = "error") -> DataFrame:
    """Numeric columns -> one vector column (M1).  NULL inputs raise unless
    ``handle_invalid`` is ``skip`` or ``keep``."""
    return assembler(features, output, handle_invalid).transform(df)


def vector_long(df: DataFrame, keys: Sequence[str], features: Sequence[str],
                vector_col: str = "features") -> DataFrame:
    """Vector column -> ``(*keys, feature, value)`` rows: ``vector_to_array``,
    zipped with the feature names and exploded (F10, F11)."""
    pairs = zip_names(vector_to_array(vector_col), features)
    return df.select(*keys, F.explode(pairs).alias("_fv")).select(
        *keys, F.col("_fv.feature").alias("feature"), F.col("_fv.value").alias("value"))


def ablation_sets(features: Sequence[str], drop: Sequence[str]) -> list[tuple[str, list[str]]]:
    """The full set plus one set per dropped feature (M4)."""
    out = [("all", list(features))]
    for d in drop:
        out.append((f"without_{d}", [f for f in features if f != d]))
    return out
