"""Scans (S3-S8): generic format reads with declared schemas, CSV reads, and
the multi-level load that unions one table per region granularity.

Declared schemas are the default so a scan never pays an extra job for
inference; ``infer_schema=True`` restores the reference's behaviour.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketml.session import materialize

# Declared schemas of the synthetic input tables used by the market work.
SCHEMAS: dict[str, T.StructType] = {
    "region": T.StructType([
        T.StructField("r_regionkey", T.IntegerType()),
        T.StructField("r_name", T.StringType()),
    ]),
    "nation": T.StructType([
        T.StructField("n_nationkey", T.IntegerType()),
        T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.IntegerType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Generic scan: ``spark.read.format(fmt).options(..).schema(..).load``."""
    reader = spark.read.format(fmt)
    if options:
        reader = reader.options(**{k: str(v) for k, v in options.items()})
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One synthetic table, read with its declared schema when we have one."""
    return read_table(spark, table_path(sf_dir, name), schema=SCHEMAS.get(name))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    header: bool = True,
    infer_schema: bool = False,
    sep: str = ",",
    **options,
) -> DataFrame:
    """CSV scan.  With a header, Spark's reader disambiguates headers that
    repeat case-insensitively by appending the column index (S8)."""
    opts = {"header": header, "sep": sep, **options}
    if schema is None:
        opts["inferSchema"] = infer_schema
    return read_table(spark, path, "csv", schema, opts)


#: Types that a text may have, in the order in which inference prefers them.
_KINDS = ("int", "bigint", "whole", "double", "date", "timestamp", "boolean")
_WHOLE = r"^[+-]?\d+$"
_DOUBLE = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)[dDfF]?\s*$|^([+-]?Inf(inity)?|NaN)$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_TIME = r"^\d{4}-\d{1,2}(-\d{1,2}([ T].+)?)?$"


def _parses_as(text: Column) -> Column:
    """The kinds that a text parses as, a bit each."""
    whole, date = text.rlike(_WHOLE), text.rlike(_DATE) & text.try_cast("date").isNotNull()
    fits = [whole & text.try_cast("int").isNotNull(), whole & text.try_cast("bigint").isNotNull(), whole, text.rlike(_DOUBLE), date,
            text.rlike(_TIME) & text.try_cast("timestamp").isNotNull(), F.lower(text).isin("true", "false")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fits)), F.lit(0))


def _type_of(kinds: int | None, fits: int | None, digits: int | None) -> str:
    """The column's type: the first kind that all of its texts parse as.  ``fits`` has the kinds of any."""
    kind = next((k for i, k in enumerate(_KINDS) if kinds is not None and kinds >> i & 1), "string")
    if kind != "whole":
        return kind
    # Whole numbers beyond 64 bits, as wide as the widest and as the types that the others would have had.
    digits = max(digits, 10 if fits & 1 else 0, 20 if fits & 2 else 0)
    return f"decimal({digits},0)" if digits <= 38 else "double"


def read_csv_typed(spark: SparkSession, path: str, header: bool = True, sep: str = ",", **options) -> DataFrame:
    """A CSV file with inferred types (S7, S8) from one parse of its text.

    The reader's own inference parses the text to find the types and again for every use.  Here the text is parsed
    once, into a Parquet copy of strings in the shared folder, and while that is written two aggregates a column
    (``DataFrame.observe``) find which types all of its values parse as.  The result casts the copy's columns.

    Types are those of the reader's inference for whole numbers, decimals beyond 64 bits, doubles, dates,
    timestamps and booleans in their default formats; columns without a value are strings.  Whole
    numbers with an exponent (``1E5``) are doubles here."""
    text = read_csv(spark, path, header=header, sep=sep, **options)
    seen = Observation("csv-types")
    value = [F.col(f"`{c}`") for c in text.columns]
    metrics = [F.count(F.lit(1)).alias("n")]
    for i, v in enumerate(value):
        kinds = F.when(v.isNotNull(), _parses_as(v))
        metrics += [F.bit_and(kinds).alias(f"all{i}"), F.bit_or(kinds).alias(f"any{i}"),
                    F.max(F.when(v.rlike(_WHOLE), F.length(F.regexp_replace(v, "^[+-]?0*", "")))).alias(f"digits{i}")]
    copy = materialize(text.observe(seen, *metrics), "csv-text")
    found = seen.get
    types = [_type_of(found[f"all{i}"], found[f"any{i}"], found[f"digits{i}"]) for i in range(len(value))]
    return copy.select(*[v.try_cast(t).alias(c) if t != "string" else v for v, t, c in zip(value, types, text.columns, strict=True)])


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> str:
    df.write.mode("errorifexists").option("header", header).option("sep", sep).csv(path)
    return path


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df.drop(*names)``; names that are absent are ignored."""
    return df.drop(*list(names))


def union_levels(frames: Mapping[str, DataFrame], level_col: str = "region_level") -> DataFrame:
    """Stack one frame per region granularity (S6), tagging each with its
    level and filling columns a level lacks with NULL."""
    out = None
    for level, frame in frames.items():
        tagged = frame.withColumn(level_col, F.lit(level))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no levels given")
    return out


def load_levels(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv",
                schema: T.StructType | str | None = None,
                options: Mapping[str, str] | None = None,
                level_col: str = "region_level") -> DataFrame:
    """Read one file per region granularity (county, state, national, ...)
    and stack them with :func:`union_levels` (S6)."""
    opts = dict(options or ({"header": "true"} if fmt == "csv" else {}))
    if fmt == "csv" and schema is None:
        opts.setdefault("inferSchema", "true")
    frames = {lv: read_table(spark, p, fmt, schema, opts) for lv, p in paths.items()}
    return union_levels(frames, level_col)
