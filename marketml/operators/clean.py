"""Cleaning (P1-P11): drop and select columns, cast dirty numerics, drop or
impute missing values.

Missing-row filters are written as explicit ``IS NOT NULL AND NOT isnan``
predicates; ``na.drop`` compiles to ``atleastnnonnulls``, which does not push
down to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Imputer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketml.functions.scalar import not_missing, to_double


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column pruning to a name list."""
    return df.select(*names)


def cast_columns(df: DataFrame, names: Iterable[str], mode: str = "try_cast") -> DataFrame:
    """Cast each named column to double in place, in one projection."""
    return df.withColumns({c: to_double(c, mode) for c in names})


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN in any column of ``subset`` (all columns
    when omitted) - P8, P9."""
    names = list(subset) if subset is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    cond = None
    for c in names:
        p = not_missing(c, types[c])
        cond = p if cond is None else cond & p
    return df if cond is None else df.where(cond)


def impute_mean(df: DataFrame, names: Sequence[str], outputs: Sequence[str] | None = None) -> DataFrame:
    """Replace NULL and NaN by the column mean of the remaining values
    (P10), with ``pyspark.ml.feature.Imputer`` (one aggregation pass)."""
    outputs = list(outputs) if outputs is not None else list(names)
    doubles = df.withColumns({c: F.col(c).cast("double") for c in names})
    imputer = Imputer(inputCols=list(names), outputCols=outputs, strategy="mean")
    return imputer.fit(doubles).transform(doubles)


def prepare(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str] = (),
    mode: str = "try_cast",
    policy: str = "drop",
) -> DataFrame:
    """The reference's clean step as one call: prune to keys + model
    columns, cast to double, then drop rows missing any model column
    (``drop``), drop rows missing the label only (``label``; for fits that impute
    from their training rows), or do that and impute features from all rows
    (``impute``)."""
    cols = [*keys, *features, label]
    out = cast_columns(df.select(*cols), [*features, label], mode)
    if policy == "drop":
        return drop_missing(out, [*features, label])
    if policy == "label":
        return drop_missing(out, [label])
    if policy == "impute":
        return impute_mean(drop_missing(out, [label]), features)
    raise ValueError("policy must be 'drop', 'label' or 'impute'")
