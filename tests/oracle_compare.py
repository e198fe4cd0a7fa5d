"""Run registered Spark queries and their DuckDB oracles side by side and
compare row count, column names and order-insensitive values."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if v is pd.NA:  # a null in a column of whole numbers; Spark's side shows it as NaN
        return ("~nan",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~nan",)
        return float(v)
    if hasattr(v, "isoformat"):
        return str(v)[:10] if len(str(v)) >= 10 else str(v)
    return v


def rows_of(df_pd):
    cols = sorted(df_pd.columns)
    out = []
    for rec in df_pd[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return cols, sorted(out, key=repr)


SPARK_TO_SQL = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
                "timestamp_ntz": "TIMESTAMP"}


def types_match(sdf, rel):
    st = {n: SPARK_TO_SQL.get(t, t.upper()) for n, t in sdf.dtypes}
    dt = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    return {k: (st.get(k), dt.get(k)) for k in set(st) | set(dt) if st.get(k) != dt.get(k)}


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    sdf = query(spark, sf_dir)
    s = sdf.toPandas()
    secs = time.time() - t
    rel = con.sql(sql)
    tdiff = types_match(sdf, rel)
    o = rel.df()
    sc, sr = rows_of(s)
    oc, orr = rows_of(o)
    ok = sc == oc and len(sr) == len(orr) and sr == orr and not tdiff
    msg = f"types {tdiff}" if tdiff else ""
    if sc != oc:
        msg = f"cols {sc} vs {oc}"
    elif len(sr) != len(orr):
        msg = f"rows {len(sr)} vs {len(orr)}"
    elif sr != orr:
        bad = [(a, b) for a, b in zip(sr, orr) if a != b]
        msg = f"{len(bad)} value diffs, first {bad[:2]}"
    return ok, secs, msg


def main(names=None, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, "/root/repo")
    from pyspark.sql import SparkSession

    import __spark_entry__ as e
    import os

    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTS", "8"))
             .config("spark.sql.adaptive.enabled", os.environ.get("AQE", "true"))
             .config("spark.sql.ansi.enabled", os.environ.get("ANSI", "true"))
             .config("spark.sql.session.timeZone", os.environ.get("TZ_SESSION", "UTC"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    fails = 0
    for name in names or list(qs):
        if name not in sqls:
            t = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"{'ROWS':5s} {name:24s} {time.time() - t:6.1f}s rows={n}", flush=True)
            continue
        try:
            ok, secs, msg = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as ex:  # report and go on
            ok, secs, msg = False, 0.0, f"{type(ex).__name__}: {str(ex)[:300]}"
        fails += not ok
        print(f"{'OK' if ok else 'FAIL':5s} {name:24s} {secs:6.1f}s {msg}", flush=True)
    return fails


if __name__ == "__main__":
    import os

    sys.exit(main(sys.argv[1:] or None, os.environ.get("SF_DIR", "/root/testdata/sf0.01")))
