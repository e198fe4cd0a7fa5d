"""Plan-shape checks: the physical plans keep the properties the design
relies on at scale (no fact table broadcast, pruned scans, pushed filters,
partial aggregation before exchanges, exact medians without a percentile
aggregate)."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from marketml.registry import QUERIES
from marketml.sources import market as mk

SF = "/root/testdata/sf0.001"


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def broadcast_scans(plan):
    """Scans that sit under a BroadcastExchange (by node id in the tree)."""
    tree = plan.split("\n\n")[0].splitlines()
    out = []
    for i, line in enumerate(tree):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            for nxt in tree[i + 1:]:
                d = len(nxt) - len(nxt.lstrip(" :+-"))
                if d <= depth:
                    break
                m = re.search(r"Scan parquet\s*\S*\s*\((\d+)\)", nxt)
                if m:
                    out.append(m.group(1))
    files = []
    for node in out:
        m = re.search(rf"\({node}\) Scan parquet.*?Location: \S+ \[([^\]]+)\]", plan, re.S)
        if m:
            files.append(m.group(1).rsplit("/", 1)[-1])
    return files


@pytest.mark.parametrize("fn", [lambda s: mk.market_facts(s, SF), lambda s: QUERIES["elapsed_format"](s, SF)])
def test_fact_tables_are_never_broadcast(spark, fn):
    plan = plan_text(fn(spark))
    assert not {"lineitem.parquet", "orders.parquet"} & set(broadcast_scans(plan))


def test_exact_median_uses_range_sort_not_percentile(spark):
    facts = mk.market_facts(spark, SF)
    m = mk.aggregate_market(facts)
    plan = plan_text(m)
    assert "percentile" not in plan.lower()


def test_approx_market_is_one_pass_and_close(spark):
    ex = {(r.region_id, r.period_begin): r for r in mk.build_market(spark, SF).collect()}
    ap = mk.build_market(spark, SF, exact=False)
    assert "percentile_approx" in plan_text(ap)
    rows = ap.collect()
    assert len(rows) == len(ex)
    for r in rows:
        e = ex[(r.region_id, r.period_begin)]
        assert (r.homes_sold, r.new_listings, r.inventory) == (e.homes_sold, e.new_listings, e.inventory)


def test_approx_market_has_no_sketch_for_every_order(spark):
    ap = mk.build_market(spark, SF, exact=False)
    plan = ap._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sketches = [ln for ln in plan if "percentile_approx" in ln]
    assert sketches and not any("distinct" in ln or "l_orderkey" in ln for ln in sketches)


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = plan_text(QUERIES["null_profile"](spark, SF))
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_extendedprice:double," \
           "l_discount:double,l_tax:double>" in plan
    from marketml.operators.clean import drop_missing
    from marketml.sources.tables import load
    dm = drop_missing(load(spark, SF, "lineitem").select("l_orderkey", "l_tax"), ["l_tax"])
    assert "PushedFilters: [IsNotNull(l_tax)]" in plan_text(dm)


def test_market_sums_partially_aggregate_before_exchange(spark):
    from marketml.session import materialize

    facts = materialize(mk.market_facts(spark, SF), "plan-test-facts")
    keys = ["region_level", *mk.KEYS]
    sums = facts.groupBy(*keys, "l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n"))
    lines = plan_text(sums).split("\n\n")[0].splitlines()
    exchanges = [i for i, ln in enumerate(lines) if "Exchange" in ln]
    assert len(exchanges) == 2
    # Every exchange is fed by a partial HashAggregate (map-side combine).
    assert all("HashAggregate" in lines[i + 1] for i in exchanges)


def test_approx_summary_quartiles_are_data_values_near_exact(spark):
    ap = {r.column_name: r for r in QUERIES["summary_approx"](spark, SF).collect()}
    ex = {r.column_name: r for r in QUERIES["summary_quartiles"](spark, SF).collect()}
    assert set(ap) == set(ex)
    for c, r in ap.items():
        span = ex[c]["max"] - ex[c]["min"]
        for p in ("p25", "p50", "p75"):
            assert abs(r[p] - ex[c][p]) <= 0.05 * span + 1e-9


def test_bucketed_inputs_join_without_exchange_and_same_market(spark):
    inputs = mk.bucketed_order_inputs(spark, SF, buckets=4)
    facts = mk.market_facts(spark, SF, "day", ("nation",), inputs)
    tree = plan_text(facts).split("\n\n")[0]
    assert "SortMergeJoin" in tree and "Exchange" not in tree
    plain = sorted(mk.build_market(spark, SF, "day").collect())
    bucketed = sorted(mk.build_market(spark, SF, "day", inputs=inputs).collect())
    assert plain == bucketed and len(plain) > 0
