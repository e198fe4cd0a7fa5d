"""Print the physical plans of the key queries (used to write PLANS.md).

    python tests/plan_dump.py /root/testdata/sf0.1 > PLANS.md
"""

import contextlib
import io
import sys

sys.path.insert(0, ".")

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().split("\n\n")[0]


def main(sf: str) -> None:
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from marketml.operators import profile
    from marketml.registry import QUERIES
    from marketml.session import materialize
    from marketml.sources import market as mk

    facts = materialize(mk.market_facts(spark, sf, stacked=False), "plan-facts")
    keys = ["region_level", *mk.KEYS]
    stacked = mk.stack_levels(facts, ("nation",))
    per_order = stacked.groupBy(*keys, "l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    sections = [
        ("Fact join (lineitem x orders x customer), plain inputs", mk.market_facts(spark, sf)),
        ("Fact join with bucketed inputs (no exchange)",
         mk.market_facts(spark, sf, inputs=mk.bucketed_order_inputs(spark, sf))),
        ("Market sums over the written facts (pre-aggregated per order, then per group)",
         per_order.groupBy(*keys).agg(F.sum("lines").alias("homes_sold"))),
        ("Market table, exact medians (final plan over the written intermediates)",
         mk.build_market(spark, sf)),
        ("Approximate market (one pass)", mk.build_market(spark, sf, exact=False)),
        ("elapsed_format (lineitem pre-aggregated per order, 1:1 merge join)",
         QUERIES["elapsed_format"](spark, sf)),
        ("series_head (top-n)", QUERIES["series_head"](spark, sf)),
        ("correlation_matrix (one aggregation)",
         profile.correlation_matrix(spark.read.parquet(f"{sf}/lineitem.parquet"),
                                    ["l_quantity", "l_extendedprice", "l_discount"])),
    ]
    print("# Physical plans\n")
    print(f"Generated by `python tests/plan_dump.py {sf}` on local[8] with 8 shuffle partitions; "
          "`AdaptiveSparkPlan` trees before execution. At sf0.1 Catalyst broadcasts the small\n"
          "dimension tables (customer, nation) by file size; at scale those joins become sort-merge joins.\n")
    for title, df in sections:
        print(f"## {title}\n\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
