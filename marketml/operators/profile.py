"""Profiling (G1-G4, G7, A1, A2): counts, null profile, describe, summary
with quartiles, correlation matrix and the ordered head of a series.

Every profile is one aggregation pass (partial aggregation on each
partition, a single small exchange) and is returned as a typed long table
rather than Spark's string-typed ``describe()`` output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.functions.scalar import is_missing
from marketml.operators.quantiles import exact_quantiles_long


def row_count(df: DataFrame) -> DataFrame:
    """G1 as a one-row table ``(n)``."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame, names: Sequence[str] | None = None,
                 include_nan: bool = False) -> DataFrame:
    """Per-column NULL count, one row with one column per input column.
    ``include_nan`` also counts NaN in floating columns."""
    names = list(names) if names is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.agg(*[
        F.count_if(is_missing(c, types[c]) if include_nan else F.col(c).isNull()).alias(c)
        for c in names
    ])


def null_profile_long(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The same profile as ``(column_name, null_count)`` rows."""
    names = list(names) if names is not None else df.columns
    wide = null_profile(df, names)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_count"))
        for c in names
    ])).alias("r")).select("r.*")


_SQL_TYPES = {
    T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE",
    T.DateType: "DATE", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
    T.TimestampNTZType: "TIMESTAMP", T.FloatType: "FLOAT", T.ShortType: "SMALLINT",
}


def sql_type(dt: T.DataType) -> str:
    return _SQL_TYPES.get(type(dt), dt.simpleString().upper())


def schema_table(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null) - the schema with a non-NULL count
    per column from one aggregation (S13)."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f.name) for f in fields])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(sql_type(f.dataType)).alias("data_type"),
                 F.col(f.name).alias("non_null"))
        for f in fields
    ])).alias("r")).select("r.*")


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _moments(c: str, number: bool):
    x = F.col(c).cast("double") if number else F.col(c).cast("string")
    none = F.lit(None).cast("double")
    return [
        F.count(x).alias(f"{c}__count"),
        (F.avg(x) if number else none).alias(f"{c}__mean"),
        (F.stddev_samp(x) if number else none).alias(f"{c}__stddev"),
        F.min(x).alias(f"{c}__min"),
        F.max(x).alias(f"{c}__max"),
    ]


def describe(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample stddev, min, max per column in one pass (G3):
    ``(column_name, count, mean, stddev, min, max)``.  By default every
    column.  Text and dates have count, min and max only; where one is among the
    columns, min and max of all are text."""
    names = list(names) if names is not None else df.columns
    numbers = {c: _is_number(df, c) for c in names}
    end = "double" if all(numbers.values()) else "string"
    wide = df.agg(*[m for c in names for m in _moments(c, numbers[c])])
    return wide.select(F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__count").alias("count"),
            F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__stddev").alias("stddev"),
            F.col(f"{c}__min").cast(end).alias("min"),
            F.col(f"{c}__max").cast(end).alias("max"),
        )
        for c in names
    ])).alias("r")).select("r.*")


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` that gathers row counts, NULL counts and ``describe``'s numbers of every column while an action
    passes over it, such as the write of a copy; ``observed_tables`` makes the tables of them."""
    seen = Observation("profile")
    metrics = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        number = _is_number(df, c)
        x = col.cast("double") if number else col.cast("string")
        metrics += [F.count(col).alias(f"count{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        metrics += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"stddev{i}")] if number else []
    return df.observe(seen, *metrics), seen


def observed_tables(df: DataFrame, seen: Observation) -> dict[str, DataFrame]:
    """``row_count``, ``schema``, ``null_profile`` and ``describe`` of the columns of ``df``, as the functions of
    these names give them, from what an observation has gathered; no scan."""
    got, spark = seen.get, df.sparkSession
    fields = list(enumerate(df.schema.fields))
    numbers = all(_is_number(df, f.name) for _, f in fields)
    end = "double" if numbers else "string"
    rows = []
    for i, f in fields:
        least, largest = got[f"min{i}"], got[f"max{i}"]
        pair = (least, largest, None, None) if _is_number(df, f.name) else (None, None, least, largest)
        rows.append((f.name, got[f"count{i}"], got.get(f"mean{i}"), got.get(f"stddev{i}"), *pair))
    described = spark.createDataFrame(rows, "column_name string, count long, mean double, stddev double, min double, max double, min_text string, max_text string")
    either = lambda m: (F.col(m) if numbers else F.coalesce(F.col(f"{m}_text"), F.col(m).cast("string"))).cast(end).alias(m)
    return {
        "row_count": spark.createDataFrame([(got["rows"],)], "n long"),
        "schema": spark.createDataFrame([(f.name, sql_type(f.dataType), got[f"count{i}"]) for i, f in fields], "column_name string, data_type string, non_null long"),
        "null_profile": spark.createDataFrame([(f.name, got["rows"] - got[f"count{i}"]) for i, f in fields], "column_name string, null_count long"),
        "describe": described.select("column_name", "count", "mean", "stddev", either("min"), either("max")),
    }


def summary(df: DataFrame, names: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75),
            exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """describe + quartiles (G4): ``(column_name, count, mean, stddev, min,
    p25, p50, p75, max)``.

    ``exact`` uses the distributed exact quantile operator (same values as
    SQL ``quantile_cont``); otherwise ``percentile_approx`` sketches inside
    the describe pass (bounded memory, one pass, approximate).
    """
    names = list(names)
    desc = describe(df, names)
    labels = [f"p{round(p * 100):d}" for p in probs]
    if exact:
        q = exact_quantiles_long(df, [], {c: F.col(c) for c in names}, probs)
        qw = q.groupBy(F.col("metric").alias("column_name")).agg(*[
            F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(lab)
            for p, lab in zip(probs, labels)
        ])
    else:
        wide = df.agg(*[
            F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(c)
            for c in names
        ])
        qw = wide.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"),
                     *[F.col(c)[i].alias(lab) for i, lab in enumerate(labels)])
            for c in names
        ])).alias("r")).select("r.*")
    # Both sides have exactly one row per profiled column: a proven bound.
    out = desc.join(F.broadcast(qw), "column_name", "left")
    return out.select("column_name", "count", "mean", "stddev", "min", *labels, "max")


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair (upper triangle with the diagonal)
    in one aggregation (G7): ``(col_a, col_b, corr)``."""
    names = list(names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    wide = df.agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])).alias("r")).select("r.*")


def series_head(df: DataFrame, time_col: str, names: Sequence[str], n: int = 10,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows in time order (A1, A2); a tie-break key makes the
    result deterministic.  Plans as ``TakeOrderedAndProject`` (per-partition
    top-n, then a merge of n rows per partition)."""
    order = [time_col, *tiebreak]
    return df.select(*dict.fromkeys([*order, *names])).orderBy(*order).limit(n)
