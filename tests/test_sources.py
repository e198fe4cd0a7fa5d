import contextlib
import io

from pyspark.sql import functions as F

from marketml.sources import tables
from marketml.sources.market import build_market, market_facts


def test_csv_duplicate_headers_get_index_suffix(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text(
        "period_begin,median_sale_price,inventory,PERIOD_BEGIN,Unnamed: 58\n"
        "2020-01-01,100,5,2020-01-01,\n"
        "2020-02-01,N/A,6,2020-02-01,\n"
    )
    df = tables.read_csv(spark, str(path), infer_schema=True)
    # Headers repeating case-insensitively get their column index appended.
    assert df.columns == ["period_begin0", "median_sale_price", "inventory", "PERIOD_BEGIN3", "Unnamed: 58"]
    kept = tables.drop_columns(df, ["PERIOD_BEGIN3", "Unnamed: 58", "not_there"])
    assert kept.columns == ["period_begin0", "median_sale_price", "inventory"]


def test_csv_declared_schema_and_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 1.0e7, "b")], "k int, v double, s string")
    path = str(tmp_path / "out")
    tables.write_csv(df, path)
    back = tables.read_csv(spark, path, schema="k int, v double, s string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_union_levels_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, 10.0)], "region_id int, price double")
    b = spark.createDataFrame([(2,)], "region_id int")
    u = tables.union_levels({"county": a, "state": b})
    rows = sorted(u.collect(), key=lambda r: r.region_id)
    assert [(r.region_level, r.price) for r in rows] == [("county", 10.0), ("state", None)]


def test_market_reference_values_sf001(spark):
    sf = "/root/testdata/sf0.01"
    m = build_market(spark, sf)
    agg = m.agg(F.count("*"), F.sum("homes_sold"), F.round(F.sum("median_sale_price"), 3),
                F.round(F.corr("median_list_price", "median_sale_price"), 8)).first()
    assert tuple(agg) == (1975, 60000, 99581082.097, 0.99225492)


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_fact_join_is_sort_merge_and_pruned(spark):
    plan = plan_text(market_facts(spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan
    # Scans read only the needed columns.
    assert ("ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,"
            "l_extendedprice:double,l_discount:double>") in plan


def test_group_with_all_null_values_keeps_its_row(spark):
    from marketml.sources.market import aggregate_market

    rows = [("n", 1, "2020-01-01", 10, 1, 2.0, 100.0, 0.05),
            ("n", 1, "2020-01-01", 10, 2, 4.0, 300.0, 0.05),
            ("n", None, "2020-01-01", 11, 1, 1.0, None, 0.0)]
    facts = spark.createDataFrame(
        rows, "region_level string, region_id int, period_begin string, l_orderkey long, "
              "l_linenumber int, l_quantity double, l_extendedprice double, l_discount double",
    ).withColumn("period_begin", F.col("period_begin").cast("date"))
    out = {r.region_id: r for r in aggregate_market(facts).collect()}
    assert set(out) == {1, None}
    assert out[1].median_list_price == 200.0 and out[1].homes_sold == 2 and out[1].new_listings == 1
    assert out[None].median_list_price is None and out[None].homes_sold == 1


def test_elapsed_format_aggregates_before_exchange(spark):
    from marketml.registry import QUERIES

    plan = plan_text(QUERIES["elapsed_format"](spark, "/root/testdata/sf0.001"))
    tree = plan.split("\n\n")[0]
    # lineitem's per-order partial aggregate sits below its exchange.
    li_branch = [ln for ln in tree.splitlines()]
    assert any("HashAggregate" in ln for ln in li_branch)
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan


def test_market_same_with_every_quantile_method(spark):
    sf = "/root/testdata/sf0.001"
    got = [sorted(build_market(spark, sf, quantile_method=m).collect()) for m in ("sort", "bracket")]
    assert got[0] == got[1] and len(got[0]) > 0


def test_load_levels_from_files(spark, tmp_path):
    (tmp_path / "county.csv").write_text("region,period_begin,median_sale_price\nA,2020-01-01,100\n")
    (tmp_path / "state.csv").write_text("region,period_begin,median_sale_price,inventory\nS,2020-01-01,200,7\n")
    df = tables.load_levels(spark, {"county": str(tmp_path / "county.csv"),
                                    "state": str(tmp_path / "state.csv")})
    rows = {r.region_level: r for r in df.collect()}
    assert rows["county"].inventory is None and rows["state"].inventory == 7
    assert rows["county"].median_sale_price == 100


def test_typed_csv_equals_the_readers_inference(spark, tmp_path):
    columns = {
        "ints": ["1", "-2", "+3", "007"], "longs": ["1", "3000000000", "", "4"], "huge": ["1", "99999999999999999999999", "5", ""],
        "mixed_huge": ["3000000000", "99999999999999999999", "1", "2"], "doubles": ["1", "2.5", "-.5", "1e3"], "special": ["NaN", "Inf", "-Inf", "1.5"],
        "dates": ["2020-01-01", "2021-2-3", "", "2022-12-31"], "times": ["2020-01-01 10:00:00", "2021-02-03T04:05:06", "", "2022-12-31 23:59:59.5"],
        "both": ["2020-01-01", "2020-01-01 10:00:00", "2021-05-06", ""], "flags": ["true", "FALSE", "", "True"], "words": ["1", "x", "2", "3"],
        "empty": ["", "", "", ""], "int_date": ["1", "2020-01-01", "", ""], "bad_date": ["2020-13-01", "2020-01-01", "", ""], "int_flag": ["1", "true", "", ""],
        "wide": ["9" * 39, "1", "", ""], "dup": ["1", "2", "3", "4"], "DUP": ["a", "b", "", "d"], "Unnamed: 58": ["", "1.25", "", ""], "N/A": ["N/A", "1", "2", "3"],
    }
    path = tmp_path / "t.csv"
    path.write_text("\n".join([",".join(columns), *[",".join(v[i] for v in columns.values()) for i in range(4)]]) + "\n")
    want = tables.read_csv(spark, str(path), infer_schema=True)
    got = tables.read_csv_typed(spark, str(path))
    assert [d for d in zip(got.dtypes, want.dtypes, strict=True) if d[0] != d[1]] == []
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_typed_csv_parses_the_text_once(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,y\n")
    df = tables.read_csv_typed(spark, str(path))
    path.unlink()  # later uses read the copy
    assert df.dtypes == [("a", "int"), ("b", "string")] and df.count() == 2
    none = tmp_path / "none.csv"
    none.write_text("a,b\n")
    assert tables.read_csv_typed(spark, str(none)).dtypes == [("a", "string"), ("b", "string")]


def test_queries_leave_the_session_as_it_is(spark):
    from marketml.registry import QUERIES

    spark.range(1).createOrReplaceTempView("market")
    before = spark.conf.get("spark.sql.caseSensitive"), sorted(t.name for t in spark.catalog.listTables())
    for name in ("sql_view", "csv_inferred"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert (spark.conf.get("spark.sql.caseSensitive"), sorted(t.name for t in spark.catalog.listTables())) == before
    assert spark.table("market").columns == ["id"]
    spark.catalog.dropTempView("market")


def test_one_level_is_no_sort_key_of_its_market(spark, monkeypatch, tmp_path):
    from datetime import datetime

    from marketml.sources import market

    day = datetime(1995, 3, 4)
    tables = {"lineitem": ([(o, k, 2.0, 100.0 * k + o, 0.1) for o in (1, 2, 3) for k in (1, 2)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"),
              "orders": ([(1, 10, day), (2, 10, day), (3, 11, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
              "customer": ([(10, 4), (11, 5)], "c_custkey long, c_nationkey int")}
    of = {name: spark.createDataFrame(*t) for name, t in tables.items()}
    monkeypatch.setattr(market, "load", lambda spark, folder, name: of[name])
    keys, median = [], market.exact_median
    monkeypatch.setattr(market, "exact_median", lambda facts, by, *a, **k: keys.append(list(by)) or median(facts, by, *a, **k))
    got = {r.region_id: r for r in market.build_market(spark, "", "month").collect()}
    assert keys == [["region_id", "period_begin"]]
    assert got[4].median_list_price == 151.5 and got[4].new_listings == 2 and got[5].median_list_price == 153.0 and got[5].homes_sold == 2
