"""The ``market`` table: one row per region x period, built from the synthetic
order tables.  It stands in for the market-tracker files the reference
models (a row is one region in one period; the label is the median sale
price).

Plan (DataFrame API, Catalyst picks join strategies from table sizes):

* ``orders`` joins ``customer`` on the customer key first (the smaller
  join), giving each order its region and period; ``lineitem`` then joins on
  the order key.  Both are equi-joins; AQE's skew handling splits a hot
  customer or order key.
* the line-level join output ("facts") is written once to the shared
  checkpoint folder: the sums, the range-partition sampling and the range
  sort all read it (column-pruned Parquet) instead of re-running the join,
  and a lost executor re-reads files rather than recomputing two shuffles;
* additive columns are pre-aggregated per order, then per region x period;
* medians use :mod:`marketml.operators.quantiles`, which never gathers one
  group into one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketml.operators.quantiles import exact_median, exact_medians_rolled_up
from marketml.session import materialize, scratch_path
from marketml.sources.tables import load

KEYS = ["region_id", "period_begin"]
FEATURES = [
    "homes_sold", "new_listings", "inventory", "median_list_price",
    "median_ppsf", "avg_sale_to_list",
]
LABEL = "median_sale_price"
MEDIANS = ["median_list_price", "median_ppsf", "median_sale_price"]
GRAINS = ("month", "day")
LEVELS = ("nation", "region", "all")


def _period(grain: str):
    day = F.to_date("o_orderdate")
    if grain == "day":
        return day
    if grain == "month":
        return F.trunc(day, "month")
    raise ValueError(f"grain must be one of {GRAINS}")


@dataclass(frozen=True)
class OrderInputs:
    """The two sides of the fact join: ``lineitem`` with the columns the
    market needs and the order dimension ``(o_orderkey, c_nationkey,
    o_orderdate)`` (orders joined with customer)."""

    lineitem: DataFrame
    orders: DataFrame


def order_inputs(spark: SparkSession, sf_dir: str) -> OrderInputs:
    """Plain scans (lazy): the fact join shuffles both sides by order key."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    od = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "c_nationkey", "o_orderdate")
    return OrderInputs(li, od)


def bucketed_order_inputs(spark: SparkSession, sf_dir: str, buckets: int | None = None) -> OrderInputs:
    """Write both sides once as tables bucketed and sorted by order key,
    under the shared checkpoint folder.  Every later market build (any grain
    or level) then joins them without an exchange: at scale the lineitem
    shuffle is paid once instead of once per build."""
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = order_inputs(spark, sf_dir)
    tag = uuid.uuid4().hex[:12]
    out = {}
    for name, df, key in (("lineitem", plain.lineitem, "l_orderkey"),
                          ("orders", plain.orders, "o_orderkey")):
        table = f"marketml_{name}_{tag}"
        (df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
         .option("path", scratch_path(spark, f"bucketed-{name}")).saveAsTable(table))
        out[name] = spark.table(table)
    return OrderInputs(out["lineitem"], out["orders"])


def market_facts(spark: SparkSession, sf_dir: str, grain: str = "month",
                 levels: Sequence[str] = ("nation",), inputs: OrderInputs | None = None,
                 stacked: bool = True) -> DataFrame:
    """Line-level facts tagged with region and period.

    ``stacked=True``: one copy per level, ``(region_level, region_id,
    period_begin, l_orderkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount)``.  ``stacked=False``: one copy, with the nation and region
    keys side by side (``c_nationkey``, ``n_regionkey``), to be stacked with
    :func:`stack_levels` after it is written, so a multi-level build writes
    the facts once."""
    inputs = inputs or order_inputs(spark, sf_dir)
    li = inputs.lineitem
    od = inputs.orders.select("o_orderkey", "c_nationkey", _period(grain).alias("period_begin"))
    if "region" in levels:
        # nation is a fixed 25-row dimension; Catalyst broadcasts it by size.
        nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        od = od.join(nation, od.c_nationkey == nation.n_nationkey, "left").drop("n_nationkey")
    else:
        od = od.withColumn("n_regionkey", F.lit(None).cast("int"))
    # Fact-to-fact join: both sides grow with the data, so pin a shuffle
    # (sort-merge) join rather than let a small test file be broadcast.
    facts = li.hint("merge").join(od, li.l_orderkey == od.o_orderkey).select(
        "c_nationkey", "n_regionkey", "period_begin",
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
    )
    return stack_levels(facts, levels) if stacked else facts


LINE_COLUMNS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


def stack_levels(facts: DataFrame, levels: Sequence[str], columns: Sequence[str] = LINE_COLUMNS) -> DataFrame:
    """One copy of each row per level, tagged ``region_level`` with its
    ``region_id`` (a narrow explode, no shuffle)."""
    region_cols = {"nation": F.col("c_nationkey"), "region": F.col("n_regionkey"), "all": F.lit(0)}
    return facts.select(
        F.explode(F.array(*[
            F.struct(F.lit(lv).alias("lv"), region_cols[lv].cast("int").alias("id"))
            for lv in levels
        ])).alias("_lv"),
        "period_begin", *columns,
    ).select(
        F.col("_lv.lv").alias("region_level"), F.col("_lv.id").alias("region_id"),
        "period_begin", *columns,
    )


def _median_inputs():
    return {
        "median_list_price": F.col("l_extendedprice"),
        "median_ppsf": F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")),
        "median_sale_price": F.col("l_extendedprice") * (1 - F.col("l_discount")),
    }


def order_sums(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive columns per key.  Lines are summed per order first, so a hot order
    collapses before the shuffle and orders are counted without a distinct."""
    keys = list(keys)
    per_order = facts.groupBy(*keys, "l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc_pct"),
    )
    return per_order.groupBy(*keys).agg(
        F.sum("lines").alias("homes_sold"),
        F.count(F.lit(1)).alias("new_listings"),
        F.sum("qty").alias("inventory"),
        F.sum("disc_pct").alias("disc_pct"),
    )


def aggregate_market(facts: DataFrame, keys: Sequence[str] = ("region_level", *KEYS),
                     exact: bool = True, accuracy: int = 10000,
                     quantile_method: str = "sort", sums: DataFrame | None = None,
                     medians: DataFrame | None = None) -> DataFrame:
    """Facts -> one row per key: counts, sums and medians.  ``sums`` and ``medians`` are the
    columns per key where the caller has them already.

    ``exact=True`` (default) uses the distributed exact quantile operator.
    ``exact=False`` is the option without a sort for very large inputs: the
    medians come from ``percentile_approx`` sketches (bounded memory per
    group, merged map-side), with rank error at most 1/``accuracy``."""
    keys = list(keys)
    sums = order_sums(facts, keys) if sums is None else sums
    if medians is not None:
        pass
    elif exact:
        medians = exact_median(facts, keys, _median_inputs(),
                               tiebreak=F.xxhash64("l_orderkey", "l_linenumber"),
                               method=quantile_method, accuracy=accuracy)
    else:
        # Apart from the orders' count: a distinct beside the sketches would keep three of them for every order.
        medians = facts.groupBy(*keys).agg(
            *[F.percentile_approx(e, 0.5, accuracy).alias(n) for n, e in _median_inputs().items()])
    # Both sides hold one row per group.  Left join, NULL-safe on the keys,
    # so a group whose values are all NULL keeps its row (NULL medians).
    m = medians.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *MEDIANS)
    cond = [sums[k].eqNullSafe(m[f"_k_{k}"]) for k in keys]
    return sums.join(m, cond, "left").select(
        *[sums[k] for k in keys],
        "homes_sold", "new_listings", "inventory",
        "median_list_price", "median_ppsf", "median_sale_price",
        (1 - F.col("disc_pct").cast("double") / (100 * F.col("homes_sold"))).alias("avg_sale_to_list"),
    )


def build_market(spark: SparkSession, sf_dir: str, grain: str = "month",
                 level: str = "nation", exact: bool = True,
                 quantile_method: str = "sort", inputs: OrderInputs | None = None) -> DataFrame:
    """The market table at one level: ``region_id, period_begin`` + features + label.

    The build reads the join output two or three times, so it is written once first."""
    facts = materialize(market_facts(spark, sf_dir, grain, (level,), inputs, stacked=False), "market-facts")
    # The level is no key: as the first one it would be compared in every step of the sort.
    return aggregate_market(stack_levels(facts, (level,)).drop("region_level"), KEYS, exact=exact,
                            quantile_method=quantile_method)


def build_market_levels(spark: SparkSession, sf_dir: str, grain: str = "month",
                        levels: Sequence[str] = LEVELS, inputs: OrderInputs | None = None) -> DataFrame:
    """All levels in one pass over the facts, tagged by ``region_level``.
    The facts are written once.  Counts and sums are made at nation level and rolled
    up (an order has one nation, so its levels add up); the wider levels' medians are
    sought between the nations' (``exact_medians_rolled_up``)."""
    facts = materialize(market_facts(spark, sf_dir, grain, levels, inputs, stacked=False),
                        "market-facts")
    added = ["homes_sold", "new_listings", "inventory", "disc_pct"]
    nations = materialize(order_sums(facts, ["c_nationkey", "n_regionkey", "period_begin"]), "market-nations")
    sums = stack_levels(nations, levels, added).groupBy("region_level", *KEYS).agg(*[F.sum(c).alias(c) for c in added])
    wider = [lv for lv in levels if lv != "nation"]
    if len(wider) == len(levels) or not wider:
        return aggregate_market(stack_levels(facts, levels), sums=sums)
    fine, wide = exact_medians_rolled_up(
        facts, ["c_nationkey", "period_begin"], _median_inputs(), nations.select("c_nationkey", "n_regionkey", "period_begin"),
        lambda rows, columns: stack_levels(rows, wider, columns), ["region_level", *KEYS], F.xxhash64("l_orderkey", "l_linenumber"))
    fine = stack_levels(fine.withColumn("n_regionkey", F.lit(None).cast("int")), ["nation"], MEDIANS)
    return aggregate_market(facts, sums=sums, medians=fine.unionByName(wide))


# The same table as SQL text (Spark SQL and DuckDB both run it); used by the
# SQL path and as the oracle.
def market_sql(grain: str = "month", level: str = "nation") -> str:
    period = {
        "month": "CAST(date_trunc('month', o_orderdate) AS DATE)",
        "day": "CAST(o_orderdate AS DATE)",
    }[grain]
    region, join = {
        "nation": ("c_nationkey", ""),
        "region": ("n_regionkey", "JOIN nation ON c_nationkey = n_nationkey"),
        "all": ("0", ""),
    }[level]
    return f"""SELECT CAST({region} AS INT) AS region_id,
       {period} AS period_begin,
       count(*) AS homes_sold,
       count(DISTINCT o_orderkey) AS new_listings,
       sum(l_quantity) AS inventory,
       median(l_extendedprice) AS median_list_price,
       median(l_extendedprice / l_quantity) AS median_ppsf,
       median(l_extendedprice * (1 - l_discount)) AS median_sale_price,
       1 - CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS avg_sale_to_list
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
{join}
GROUP BY 1, 2"""
