import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.__main__ import main
from planweave.functions.profile import ProfileSettings, equi_depth, physically_ordered, profile_table, sample, summary
from planweave.functions.text import lines
from planweave.plans.catalog import Catalog
from planweave.plans.compile import compile_plan
from planweave.plans.plan import PlanError, scan, to_json, where
from planweave.plans.types import Ref, i32, i64, text
from planweave.sources.blocks import decode_block, pack_blocks, read_blocks, write_blocks
from planweave.sources.pipe import read_pipe, write_pipe
from planweave.sources.results import first_difference, result_lines, same_bag
from planweave.sources.schema_file import columns_of, discover, struct_of
from planweave.streaming.live import follow

SF = "/root/testdata/sf0.001"


def test_schema_files():
    columns = columns_of("a|b|c|\ni32|Float64|STRING|\n")
    assert [(c.name, c.type) for c in columns] == [("a", "Int32"), ("b", "Float64"), ("c", "String")]
    for broken in ("", "a|b", "a|b\nI32", "a\nDECIMAL"):
        with pytest.raises(PlanError):
            columns_of(broken)


def test_bar_separated_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1|plain|last|\n2| spaced ||\n3|"quoted"|NULL|\n4||#|\n')
    (tmp_path / "t.schema").write_text("a|b|c\nI32|STRING|STRING\n")
    (tmp_path / "bare.csv").write_text("1|\n")
    with pytest.warns(UserWarning, match="bare"):
        catalog = discover(str(tmp_path))
    rows = [tuple(r) for r in compile_plan(scan("t").sort("a"), catalog, spark).collect()]
    assert rows == [(1, "plain", "last"), (2, " spaced ", ""), (3, '"quoted"', "NULL"), (4, "", "#")]
    schema = struct_of(catalog.tables["t"].columns)
    write_pipe(read_pipe(spark, str(tmp_path / "t.csv"), schema), str(tmp_path / "again"))
    assert same_bag(read_pipe(spark, str(tmp_path / "again"), schema), read_pipe(spark, str(tmp_path / "t.csv"), schema))
    (tmp_path / "bad.csv").write_text("x|b|c|\n")
    with pytest.raises(Exception):
        read_pipe(spark, str(tmp_path / "bad.csv"), schema).collect()


@pytest.mark.parametrize("size", [64, 512, 4096])
def test_block_files(spark, tmp_path, size):
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])
    rows = [(k - 50, k * 2**40, k / 3, k / 7, "é" * (k % 9)) for k in range(300)]
    df = spark.createDataFrame(rows, schema).repartition(3, "i")
    path = str(tmp_path / "t.bin")
    n = write_blocks(df, path, size)
    assert (tmp_path / "t.bin").stat().st_size == n * size
    assert same_bag(read_blocks(spark, path, schema, size), df)
    catalog = Catalog.from_json('{"tables": [{"name": "t", "path": "%s", "format": "blocks", "rows": null, "options": {"block_size": %d}, "columns": [%s]}]}' % (path, size, ",".join('{"name": "%s", "type": "%s", "stats": {}}' % (a, b) for a, b in (("i", "Int32"), ("l", "Int64"), ("f", "Float32"), ("d", "Float64"), ("s", "String")))))
    assert compile_plan(scan("t").filter("i", "GTE", i32(0)), catalog, spark).count() == 250
    profile_table(catalog, catalog.frame(spark, "t"), "t")  # statistics do not replace the size of blocks
    again = Catalog.from_json(catalog.to_json())
    assert again.tables["t"].rows == 300 and same_bag(again.frame(spark, "t"), df)
    numbers = df.drop("s")
    write_blocks(numbers, path, size)
    assert same_bag(read_blocks(spark, path, numbers.schema, size), numbers)


def test_dates_in_parquet(spark, tmp_path):
    spark.sql("SELECT 1 AS k, DATE '2020-02-03' AS d").write.parquet(str(tmp_path / "t"))
    catalog = Catalog()
    catalog.add("t", spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"))
    again = Catalog.from_json(catalog.to_json())
    assert [str(r["d"]) for r in again.frame(spark, "t").collect()] == ["2020-02-03 00:00:00"]


def test_catalogs_of_table_specifications(spark):
    catalog = Catalog.from_directory(spark, SF, ("nation",))
    profile_table(catalog, catalog.frame(spark, "nation"), "nation")
    again = Catalog.from_json(catalog.to_specs())
    assert again.tables["nation"].rows == 25 and again.tables["nation"].format == "parquet"
    for a, b in zip(catalog.tables["nation"].columns, again.tables["nation"].columns, strict=True):
        assert (a.name, a.type) == (b.name, b.type)
        assert {k: v for k, v in a.stats.items() if k in ("ordered", "range", "histogram", "density") and v is not False} == b.stats
    made = Catalog.from_json('{"table_specs": [{"name": "t", "file_id": "t.bin", "column_specs": [{"column_name": "k", "data_type": "Int32", "stats": ["IsPhysicallyOrdered", {"CardinalityStat": 7}, {"RangeStat": {"lower_bound": {"Int32": 1}, "upper_bound": {"Int32": 9}}}]}, {"column_name": "s", "data_type": "String", "stats": null}]}]}')
    assert made.tables["t"].rows == 7 and made.tables["t"].format == "blocks" and made.tables["t"].columns[0].stats == {"ordered": True, "range": [1, 9]}
    with pytest.raises(PlanError):
        Catalog.from_json('{"table_specs": [{"name": "t", "file_id": "t", "column_specs": [{"column_name": "k", "data_type": "Int8", "stats": null}]}]}')


def test_block_layout():
    blocks = list(pack_blocks(iter([b"abc\0", b"de\0", b"f" * 13 + b"\0"]), 16))
    assert [struct.unpack("<H", b[-2:])[0] for b in blocks] == [2, 1]
    assert decode_block(blocks[0], [T.StringType()]) == [["abc"], ["de"]]
    with pytest.raises(ValueError):
        list(pack_blocks(iter([b"x" * 15]), 16))


def test_values_as_text(spark):
    cases = {1.0: "1.0", 0.1: "0.1", 12345678.0: "12345678.0", 1e20: "100000000000000000000.0", 1e-5: "0.00001", -2.5: "-2.5", 0.0: "0.0", float("inf"): "inf", float("-inf"): "-inf", 123456.789: "123456.789", 0.001: "0.001", 9999999.5: "9999999.5"}
    cases |= {float(np.float64(m) * 10.0**e): np.format_float_positional(float(np.float64(m) * 10.0**e), unique=True, trim="0") for m in (1, -7, 1.25, 3.0000001, -9.87654321) for e in range(-30, 31, 3)}
    cases |= {v: np.format_float_positional(v, unique=True, trim="0") for v in (5e-324, 1e23, 2e23, 9.5e-323, 17366547000.000002, 1.7976931348623157e308)}
    df = spark.createDataFrame([(v,) for v in cases], "d double")
    assert {r["line"] for r in lines(df).collect()} == {w + "|" for w in cases.values()}
    mixed = spark.createDataFrame([(1, 2, 0.1, "a|b"), (None, None, None, None)], "a int, b long, f float, s string")
    assert [r["line"] for r in lines(mixed).collect()] == ["1|2|0.10000000149011612|a|b|", "||||"]
    assert [r["line"] for r in lines(spark.createDataFrame([(float("nan"),)], "d double")).collect()] == ["nan|"]


def test_results_and_their_comparison(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").orderBy("k")
    assert list(result_lines(df)) == ["validate", "1|a|", "2|b|", "!"]
    assert first_difference(iter(["a ", "b"]), iter(["a", "b\n"])) is None
    assert first_difference(iter(["a", "x"]), iter(["a", "b"])) == (2, "x", "b")
    assert first_difference(iter(["a"]), iter(["a", "b"])) == (2, None, "b")
    twice = df.union(df.limit(1))
    assert not same_bag(df, twice) and same_bag(twice, df.limit(1).union(df))


def test_summary_and_density(spark):
    df = spark.createDataFrame([(k % 7, float(k), f"s{k % 3}", None) for k in range(100)], "a int, d double, s string, z string")
    rows = {r["column_name"]: r for r in summary(df).collect()}
    assert (rows["a"]["min_value"], rows["a"]["max_value"], rows["a"]["distinct_count"], rows["a"]["row_count"]) == (0.0, 6.0, 7, 100)
    assert rows["s"]["min_value"] is None and rows["s"]["distinct_count"] == 3 and rows["z"]["distinct_count"] == 0
    assert rows["d"]["density"] == 1.0
    assert summary(df.limit(0)).filter("density IS NOT NULL").count() == 0
    estimate = summary(spark.range(50_000), ["id"], ProfileSettings(exact_distinct=100)).first()["distinct_count"]
    assert abs(estimate - 50_000) < 50_000 * 5 * 1.04 / 64


@pytest.mark.parametrize("values", [list(range(97)), [5] * 40 + list(range(13)), [3], [], [1, 1, 2]])
def test_equi_depth_histogram(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    found = {r["bucket"]: (r["low"], r["high"], r["frequency"]) for r in equi_depth(df, "v", ProfileSettings(ranges=5)).collect()}
    wanted: dict = {}
    for rank, v in enumerate(sorted(values)):
        b = rank * 10 // len(values)
        low, high, n = wanted.get(b, (v, v, 0))
        wanted[b] = (min(low, v), max(high, v), n + 1)
    assert found == wanted


def test_physical_order(spark, tmp_path):
    spark.range(1000).selectExpr("id AS up", "-id AS down", "id % 500 AS saw").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for settings in (None, ProfileSettings(rows_per_range=100), ProfileSettings(rows_per_range=500)):
        assert [physically_ordered(df, c, settings) for c in ("up", "down", "saw")] == [True, False, False]


def test_profile_goes_into_the_catalog(spark):
    catalog = Catalog.from_directory(spark, SF, ("nation", "supplier"))
    stats = profile_table(catalog, catalog.frame(spark, "supplier"), "supplier")
    spec = Catalog.from_json(catalog.to_json()).tables["supplier"]
    assert spec.rows == catalog.frame(spark, "supplier").count()
    assert stats["s_suppkey"]["distinct"] == spec.rows and stats["s_suppkey"]["ordered"]
    assert sum(h[2] for h in stats["s_acctbal"]["histogram"]) == spec.rows
    assert sample(spark.range(1000), 10).count() == 10


def test_command_line(tmp_path, capsys, spark):
    plan = tmp_path / "plan.json"
    plan.write_text(to_json(scan("nation").filter("n_nationkey", "LT", i32(2)).sort("n_nationkey").project("n_nationkey", "n_name").build()))
    assert main(["show", str(plan)]) == 0 and "Project" in capsys.readouterr().out
    assert main(["run", str(plan), "--data", SF]) == 0
    assert capsys.readouterr().out.splitlines() == ["validate", "0|NATION_0|", "1|NATION_1|", "!"]
    (tmp_path / "good").write_text("0|NATION_0|\n1|NATION_1|\n")
    (tmp_path / "bad").write_text("0|NATION_0|\n")
    assert main(["run", str(plan), "--data", SF, "--expect", str(tmp_path / "good")]) == 0
    assert main(["run", str(plan), "--data", SF, "--expect", str(tmp_path / "bad")]) == 1


def test_plans_over_arriving_files(spark, tmp_path):
    catalog = Catalog.from_directory(spark, SF, ("customer", "nation"))
    folder = tmp_path / "in"
    catalog.frame(spark, "customer").filter("c_custkey < 50").write.parquet(str(folder))
    query = scan("customer").cross(scan("nation")).filter(where("c_nationkey", "EQ", Ref("n_nationkey")), where("c_mktsegment", "NE", text("BUILDING"))).project("c_custkey", "n_name").build()
    live = follow(query, catalog, spark, "customer", str(folder))
    running = live.writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        running.processAllAvailable()
        catalog.frame(spark, "customer").filter("c_custkey >= 50").write.mode("append").parquet(str(folder))
        running.processAllAvailable()
    finally:
        running.stop()
    assert same_bag(spark.table("arrived"), compile_plan(query, catalog, spark))
    for bad in (scan("customer").sort("c_custkey"), scan("nation")):
        with pytest.raises(PlanError):
            follow(bad.build(), catalog, spark, "customer", str(folder))
    assert catalog.frame(spark, "customer").filter(F.col("c_custkey") == 1).count() == compile_plan(scan("customer").filter("c_custkey", "EQ", i64(1)), catalog, spark).count()
