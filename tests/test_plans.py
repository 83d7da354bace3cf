import math

import pytest
from pyspark.sql import functions as F

from planweave.operators.joins import cartesian_products, hinted
from planweave.plans.catalog import Catalog
from planweave.plans.check import output_types
from planweave.plans.compile import compile_plan
from planweave.plans.plan import PlanError, from_json, scan, to_json, where
from planweave.plans.types import Ref, f32, f64, i32, i64, text, timestamp
from planweave.workload import ENTRIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Catalog.from_directory(spark, SF, TABLES)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    made, folder = Catalog(), tmp_path_factory.mktemp("edges")

    def kept(name, df):  # as files, so that sizes are known
        df.write.parquet(f"{folder}/{name}")
        made.add(name, spark.read.parquet(f"{folder}/{name}"))

    rows = [(1, 2**40, math.nan, 1.5, "é"), (-(2**31), -(2**63), 0.1, -0.0, ""), (2**31 - 1, 2**63 - 1, math.inf, 0.0, "Z"), (0, 0, -math.inf, math.nan, "a")]
    made.add("typed", spark.createDataFrame(rows, "a int, b long, f float, d double, s string"))
    kept("left", spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, v string"))
    kept("right", spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (4, "w")], "k2 long, v2 string"))
    kept("empty", spark.createDataFrame([], "k3 long, v3 string"))
    return made


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_json_round_trip_and_output_names(name, tables):
    query = ENTRIES[name].plan.build()
    assert from_json(to_json(query)) == query
    assert output_types(query, tables)


def test_json_shape():
    plan = scan("people").filter("age", ">=", i64(30)).cross(scan("towns").sort("-size")).filter("home", "!=", Ref("town")).project("name", ("town", "place")).build()
    towns = '{"Sort": {"sort_specs": [{"column_name": "size", "ascending": false}], "underlying": {"Scan": {"table_id": "towns"}}}}'
    people = '{"Filter": {"predicates": [{"column_name": "age", "operator": "GTE", "value": {"I64": 30}}], "underlying": {"Scan": {"table_id": "people"}}}}'
    pairs = '{"Filter": {"predicates": [{"column_name": "home", "operator": "NE", "value": {"Column": "town"}}], "underlying": {"Cross": {"left": %s, "right": %s}}}}' % (people, towns)
    document = '{"root": {"Project": {"column_name_map": [["name", "name"], ["town", "place"]], "underlying": %s}}}' % pairs
    assert from_json(document) == plan and to_json(plan) == document


@pytest.mark.parametrize("broken", ["", "{}", '{"root": 3}', '{"root": {"Scan": {}}}', '{"root": {"Limit": {}}}', '{"root": {"Filter": {"predicates": [{"column_name": "a", "operator": "LIKE", "value": {"I32": 1}}], "underlying": {"Scan": {"table_id": "t"}}}}}', '{"root": {"Filter": {"predicates": [{"column_name": "a", "operator": "EQ", "value": {"I32": 2147483648}}], "underlying": {"Scan": {"table_id": "t"}}}}}', '{"root": {"Filter": {"predicates": [{"column_name": "a", "operator": "EQ", "value": {"I64": "1"}}], "underlying": {"Scan": {"table_id": "t"}}}}}'])
def test_malformed_plans(broken):
    with pytest.raises(PlanError):
        from_json(broken)


def test_analysis_errors(tables):
    for plan, word in (
        (scan("nowhere"), "nowhere"),
        (scan("nation").filter("x", "EQ", i32(1)), "x"),
        (scan("nation").filter("n_regionkey", "EQ", i64(1)), "Int32"),
        (scan("nation").filter("n_name", "EQ", i32(1)), "String"),
        (scan("part").filter("p_retailprice", "LT", f32(1.0)), "Float64"),
        (scan("nation").filter("n_regionkey", "EQ", Ref("n_name")), "operand is String"),
        (scan("nation").project(("n_name", "a"), ("n_regionkey", "a")), "twice"),
        (scan("nation").project(), "no columns"),
        (scan("nation").sort("x"), "x"),
        (scan("nation").cross(scan("nation")), "both sides"),
        (scan("nation").project("n_name").filter("n_regionkey", "EQ", i32(1)), "n_regionkey"),
    ):
        with pytest.raises(PlanError, match=word):
            output_types(plan, tables)
    with pytest.raises(PlanError):
        where("a", "EQ", 3)


def test_nan_and_zero(spark, edges):
    def found(column, operator, value):
        return sorted(r["a"] for r in compile_plan(scan("typed").filter(column, operator, value).project("a"), edges, spark).collect())

    assert found("d", "EQ", f64(0.0)) == [-(2**31), 2**31 - 1]
    assert found("d", "NE", f64(0.0)) == [0, 1]
    assert found("d", "GT", f64(-1.0)) == [-(2**31), 1, 2**31 - 1]
    assert found("f", "GTE", f32(0.1)) == [-(2**31), 2**31 - 1]
    assert found("d", "NE", f64(math.nan)) == [-(2**31), 0, 1, 2**31 - 1]
    assert found("d", "EQ", f64(math.nan)) == []
    assert found("s", "LT", text("a")) == [-(2**31), 2**31 - 1]
    assert found("b", "GT", i64(2**40)) == [2**31 - 1]


def test_joins_of_every_kind(spark, edges):
    plan = scan("left").cross(scan("right")).filter("k", "EQ", Ref("k2"))
    wanted = sorted([(1, a, 1, b) for a in "ab" for b in "xy"] + [(2, "c", 2, "z")])
    for strategy, node in ((None, ""), ("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("nested_loop", "CartesianProduct")):
        df = compile_plan(plan, edges, spark, strategy=strategy)
        assert sorted(map(tuple, df.collect())) == wanted
        assert node in df._jdf.queryExecution().sparkPlan().toString()
    theta = compile_plan(scan("left").cross(scan("right")).filter("k", "LT", Ref("k2")), edges, spark)
    assert theta.count() == sum(a < b for a in (1, 1, 2, 3) for b in (1, 1, 2, 4))
    for operator in ("EQ", "LT"):
        for plan in (scan("left").cross(scan("empty")).filter("k", operator, Ref("k3")), scan("empty").cross(scan("left")).filter("k3", operator, Ref("k"))):
            assert compile_plan(plan, edges, spark).count() == 0
    residual = compile_plan(scan("left").cross(scan("right")).filter(where("k", "EQ", Ref("k2")), where("v", "NE", text("a"))), edges, spark)
    assert residual.count() == 3
    with pytest.raises(ValueError):
        hinted(spark.range(1), "guess")
    unknown = spark.createDataFrame([(1,)], "k long")  # no known size: not broadcast on request
    assert "merge" in hinted(unknown, "broadcast")._jdf.queryExecution().logical().toString()


def test_no_product_is_left_in_equi_joins(spark, tables):
    for name in ("q36", "q47", "b2", "b4", "b8", "b10"):
        assert cartesian_products(compile_plan(ENTRIES[name].plan, tables, spark)) == 0, name


def test_filters_and_columns_reach_the_scan(spark, tables):
    plan = compile_plan(ENTRIES["b3"].plan, tables, spark)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate" in plan and "GreaterThan(l_shipdate" in plan
    assert "l_extendedprice" not in plan
    nan = compile_plan(scan("part").filter("p_retailprice", "GTE", f64(950.0)).project("p_partkey"), tables, spark)
    assert "GreaterThanOrEqual(p_retailprice,950.0)" in nan._jdf.queryExecution().executedPlan().toString()


def test_sorts_are_stable_through_projections(spark, edges):
    plan = scan("left").sort("-v").project(("k", "key"), ("v", "value")).filter("value", "NE", text("d")).sort("key")
    assert [tuple(r) for r in compile_plan(plan, edges, spark).collect()] == [(1, "b"), (1, "a"), (2, "c")]
    hidden = scan("left").sort("-v").project(("k", "key")).sort("key")
    df = compile_plan(hidden, edges, spark)
    assert df.columns == ["key"] and [r["key"] for r in df.collect()] == [1, 1, 2, 3]


@pytest.mark.parametrize("name", ["q18", "q26", "b1", "b3", "b9"])
def test_sorted_results_come_in_order(spark, tables, name):
    entry = ENTRIES[name]
    sort = next(n for n in (entry.plan.child, getattr(entry.plan.child, "child", None)) if hasattr(n, "keys"))
    rows = compile_plan(sort, tables, spark).collect()
    for a, b in zip(rows, rows[1:], strict=False):
        for key, up in sort.keys:
            if a[key] != b[key]:
                assert (a[key] < b[key]) == up
                break


def test_dates_and_catalog_json(spark, tables):
    assert compile_plan(scan("orders").filter("o_orderdate", "LT", timestamp("1995-03-15")), tables, spark).count() == spark.read.parquet(f"{SF}/orders.parquet").filter(F.col("o_orderdate") < "1995-03-15").count()
    again = Catalog.from_json(tables.to_json())
    assert again.types("nation") == tables.types("nation")
    assert compile_plan(ENTRIES["b3"].plan, again, spark).count() == compile_plan(ENTRIES["b3"].plan, tables, spark).count()
