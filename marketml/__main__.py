"""Command line: repeat one of the reference's scripts on a file.

    python -m marketml gbt path/to/tracker.csv --keys region,period_begin
    spark-submit --py-files marketml.zip -m marketml linear tracker.parquet --format parquet

The session comes from the launcher (``spark-submit`` settings or the
defaults); every result table is shown and, with ``--out``, also written as
Parquet under that folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from marketml.plans.presets import PRESETS
from marketml.plans.workflows import reference_workflow


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="marketml", description=__doc__.splitlines()[0])
    ap.add_argument("script", choices=sorted(PRESETS))
    ap.add_argument("path")
    ap.add_argument("--format", default="csv")
    ap.add_argument("--keys", default="", help="comma-separated columns hashed for the split")
    ap.add_argument("--no-tune", action="store_true", help="baseline only")
    ap.add_argument("--out", default=None, help="folder to write every table to as Parquet")
    ap.add_argument("--rows", type=int, default=20)
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"marketml-{args.script}").getOrCreate()
    keys = [k for k in args.keys.split(",") if k]
    tables = reference_workflow(spark, args.path, args.script, fmt=args.format, keys=keys,
                                tune=not args.no_tune)
    for name, df in tables.items():
        print(f"=== {name} ===")
        df.show(args.rows, truncate=False)
        if args.out:
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
