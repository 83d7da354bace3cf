"""The query workload: plans over the sample tables, each with the SQL that must give the same rows.

Names follow the categories: q1-q5 scans and projections, q6-q15 filters, q16-q20 sorts, q21-q30 filters with sorts, q31-q35 products,
q36-q40 joins, q41-q50 joins with filters and sorts, b1-b10 longer joins, then plans that exercise one rewrite or one join each.
The sample tables have no table between part and supplier; lineitem, which has both keys, takes its place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions.profile import ProfileSettings, equi_depth, physically_ordered, summary
from planweave.functions.text import lines
from planweave.plans.catalog import Catalog, ColumnSpec, TableSpec
from planweave.plans.compile import compile_plan
from planweave.plans.plan import Plan, Query, from_json, scan, tables_of, to_json, where
from planweave.plans.types import Ref, f32, f64, i32, i64, of_spark, text, timestamp
from planweave.sources.blocks import read_blocks, write_blocks
from planweave.sources.pipe import write_pipe
from planweave.sources.schema_file import columns_of

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@dataclass(frozen=True)
class Entry:
    plan: Plan
    sql: str
    strategy: str | None = None


def _same(a: str, b: str):
    return where(a, "EQ", Ref(b))


def _entries() -> dict[str, Entry]:
    region, nation, customer, supplier, part, orders, lineitem = map(scan, TABLES)
    q: dict[str, Entry] = {}

    def add(name: str, plan: Plan, sql: str, strategy: str | None = None) -> None:
        q[name] = Entry(plan, sql, strategy)

    # Scans and projections.
    add("q1", nation.project("n_nationkey", "n_name", "n_regionkey"), "SELECT n_nationkey, n_name, n_regionkey FROM nation")
    add("q2", region.project("r_regionkey", "r_name"), "SELECT r_regionkey, r_name FROM region")
    add("q3", part.project("p_partkey", "p_name", "p_brand", "p_type"), "SELECT p_partkey, p_name, p_brand, p_type FROM part")
    add("q4", supplier.project("s_suppkey", "s_name", "s_acctbal"), "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
    add("q5", customer.project("c_custkey", "c_name", "c_mktsegment"), "SELECT c_custkey, c_name, c_mktsegment FROM customer")
    # Filters.
    add("q6", nation.filter("n_regionkey", "EQ", i32(1)).project("n_name"), "SELECT n_name FROM nation WHERE n_regionkey = 1")
    add("q7", region.filter("r_name", "NE", text("AFRICA")).project("r_name"), "SELECT r_name FROM region WHERE r_name <> 'AFRICA'")
    add("q8", part.filter("p_size", "GT", i32(25)).project("p_name", "p_size"), "SELECT p_name, p_size FROM part WHERE p_size > 25")
    add("q9", part.filter("p_retailprice", "GTE", f64(950.0)).project("p_partkey", "p_retailprice"), "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950.0")
    add("q10", supplier.filter("s_acctbal", "LT", f64(0.0)).project("s_name", "s_acctbal"), "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < 0.0")
    add("q11", customer.filter("c_mktsegment", "EQ", text("AUTOMOBILE")).project("c_name", "c_mktsegment"), "SELECT c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'AUTOMOBILE'")
    add("q12", orders.filter("o_orderstatus", "EQ", text("O")).project("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
    add("q13", lineitem.filter("l_quantity", "LTE", f64(10.0)).project("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 10")
    add("q14", lineitem.filter("l_quantity", "GT", f64(40.0)).project("l_partkey", "l_suppkey"), "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40")
    add("q15", lineitem.filter(where("l_discount", "GTE", f64(0.05)), where("l_discount", "LTE", f64(0.07))).project("l_orderkey", "l_discount"), "SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07")
    # Sorts.
    add("q16", nation.sort("n_name", "n_nationkey").project("n_name"), "SELECT n_name FROM nation ORDER BY n_name, n_nationkey")
    add("q17", region.sort("-r_name", "r_regionkey").project("r_name"), "SELECT r_name FROM region ORDER BY r_name DESC, r_regionkey")
    add("q18", part.sort("p_brand", "-p_size", "p_partkey").project("p_brand", "p_size"), "SELECT p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey")
    add("q19", supplier.sort("-s_acctbal", "s_suppkey").project("s_acctbal", "s_name"), "SELECT s_acctbal, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
    add("q20", customer.sort("c_mktsegment", "-c_acctbal", "c_custkey").project("c_mktsegment", "c_acctbal"), "SELECT c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
    # Filters with sorts.
    add("q21", nation.filter("n_regionkey", "EQ", i32(3)).sort("-n_name", "n_nationkey").project("n_name"), "SELECT n_name FROM nation WHERE n_regionkey = 3 ORDER BY n_name DESC, n_nationkey")
    add("q22", part.filter("p_size", "LT", i32(10)).sort("p_name", "p_partkey").project("p_name"), "SELECT p_name FROM part WHERE p_size < 10 ORDER BY p_name, p_partkey")
    add("q23", supplier.filter("s_acctbal", "GT", f64(5000.0)).sort("-s_acctbal", "s_suppkey").project("s_name", "s_acctbal"), "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal > 5000 ORDER BY s_acctbal DESC, s_suppkey")
    add("q24", customer.filter("c_mktsegment", "EQ", text("HOUSEHOLD")).sort("c_name", "c_custkey").project("c_name"), "SELECT c_name FROM customer WHERE c_mktsegment = 'HOUSEHOLD' ORDER BY c_name, c_custkey")
    add("q25", orders.filter("o_orderstatus", "EQ", text("F")).sort("-o_totalprice", "o_orderkey").project("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey")
    add("q26", lineitem.filter("l_shipdate", "GT", timestamp("1998-01-01")).sort("-l_quantity", "l_orderkey", "l_linenumber").project("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01' ORDER BY l_quantity DESC, l_orderkey, l_linenumber")
    add("q27", lineitem.filter("l_quantity", "LT", f64(3.0)).sort("l_suppkey", "l_partkey").project("l_suppkey"), "SELECT l_suppkey FROM lineitem WHERE l_quantity < 3 ORDER BY l_suppkey, l_partkey")
    add("q28", lineitem.filter(where("l_returnflag", "EQ", text("R")), where("l_linestatus", "EQ", text("F"))).sort("-l_extendedprice", "l_orderkey", "l_linenumber").project("l_extendedprice"), "SELECT l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
    add("q29", customer.filter("c_acctbal", "LT", f64(0.0)).sort("c_name", "c_custkey").project("c_name"), "SELECT c_name FROM customer WHERE c_acctbal < 0 ORDER BY c_name, c_custkey")
    add("q30", part.filter("p_type", "EQ", text("PROMO")).sort("p_brand", "p_partkey").project("p_brand"), "SELECT p_brand FROM part WHERE p_type = 'PROMO' ORDER BY p_brand, p_partkey")
    # Products.
    add("q31", nation.cross(region).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region")
    add("q32", supplier.cross(region).project("s_name", "r_name"), "SELECT s_name, r_name FROM supplier, region")
    add("q33", customer.filter("c_custkey", "EQ", i64(1)).cross(nation).project("c_name", "n_name"), "SELECT c_name, n_name FROM customer, nation WHERE c_custkey = 1")
    add("q34", part.filter("p_partkey", "EQ", i64(10)).cross(supplier.filter("s_suppkey", "LT", i64(10))).project("p_name", "s_acctbal"), "SELECT p_name, s_acctbal FROM part, supplier WHERE p_partkey = 10 AND s_suppkey < 10")
    add("q35", orders.filter("o_orderkey", "EQ", i64(5)).cross(lineitem.filter("l_orderkey", "EQ", i64(5))).project("o_orderkey", "l_linenumber"), "SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE o_orderkey = 5 AND l_orderkey = 5")
    # Joins.
    add("q36", nation.cross(region).filter(_same("n_regionkey", "r_regionkey")).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
    add("q37", customer.cross(nation).filter(_same("c_nationkey", "n_nationkey")).project("c_name", "n_name"), "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    add("q38", supplier.cross(nation).filter(_same("s_nationkey", "n_nationkey")).project("s_name", "n_name"), "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
    add("q39", part.cross(lineitem).filter(_same("p_partkey", "l_partkey")).project("p_name", "l_quantity"), "SELECT p_name, l_quantity FROM part JOIN lineitem ON p_partkey = l_partkey")
    add("q40", supplier.cross(lineitem).filter(_same("s_suppkey", "l_suppkey")).project("s_name", "l_quantity"), "SELECT s_name, l_quantity FROM supplier JOIN lineitem ON s_suppkey = l_suppkey")
    # Joins with filters and sorts.
    add("q41", customer.cross(orders).filter(_same("c_custkey", "o_custkey"), where("c_mktsegment", "EQ", text("MACHINERY"))).sort("-o_totalprice", "c_custkey", "o_orderkey").project("c_name", "o_totalprice"), "SELECT c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' ORDER BY o_totalprice DESC, c_custkey, o_orderkey")
    q42 = orders.cross(lineitem).filter(_same("o_orderkey", "l_orderkey"), where("o_orderstatus", "EQ", text("P"))).sort("o_orderdate", "l_orderkey", "l_linenumber").project("o_orderdate", "l_quantity")
    sql42 = "SELECT o_orderdate, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate, l_orderkey, l_linenumber"
    add("q42", q42, sql42)
    add("q43", nation.cross(region).filter(_same("n_regionkey", "r_regionkey"), where("r_name", "EQ", text("EUROPE"))).sort("n_name", "n_nationkey").project("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' ORDER BY n_name, n_nationkey")
    add("q44", supplier.cross(nation).filter(_same("s_nationkey", "n_nationkey"), where("s_acctbal", "GT", f64(1000.0))).sort("-s_acctbal", "s_suppkey").project("s_name", "n_name"), "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000 ORDER BY s_acctbal DESC, s_suppkey")
    add("q45", part.cross(lineitem).filter(_same("p_partkey", "l_partkey"), where("p_size", "EQ", i32(50))).sort("-l_extendedprice", "p_partkey", "l_suppkey").project("p_name", "l_extendedprice"), "SELECT p_name, l_extendedprice FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size = 50 ORDER BY l_extendedprice DESC, p_partkey, l_suppkey")
    add("q46", customer.cross(nation).cross(region).filter(_same("c_nationkey", "n_nationkey"), _same("n_regionkey", "r_regionkey"), where("r_name", "EQ", text("ASIA"))).sort("c_name", "c_custkey").project("c_name", "n_name"), "SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' ORDER BY c_name, c_custkey")
    add("q47", part.cross(supplier).cross(lineitem).filter(_same("p_partkey", "l_partkey"), _same("s_suppkey", "l_suppkey"), where("p_size", "LT", i32(5))).sort("p_brand", "s_name", "p_partkey", "s_suppkey").project("p_brand", "s_name"), "SELECT p_brand, s_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_size < 5 ORDER BY p_brand, s_name, p_partkey, s_suppkey")
    add("q48", orders.cross(customer).filter(_same("o_custkey", "c_custkey"), where("o_totalprice", "GT", f64(50000.0))).sort("-o_totalprice", "o_orderkey").project("o_orderkey", "c_mktsegment"), "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 ORDER BY o_totalprice DESC, o_orderkey")
    add("q49", lineitem.cross(part).filter(_same("l_partkey", "p_partkey"), where("l_quantity", "GT", f64(45.0))).sort("p_name", "l_orderkey", "l_linenumber").project("l_linenumber", "p_name"), "SELECT l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 ORDER BY p_name, l_orderkey, l_linenumber")
    add("q50", supplier.cross(part).cross(lineitem).filter(_same("s_suppkey", "l_suppkey"), _same("p_partkey", "l_partkey"), where("l_quantity", "EQ", f64(1.0))).sort("s_name", "p_name", "s_suppkey", "p_partkey").project("s_name", "p_name"), "SELECT s_name, p_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity = 1 ORDER BY s_name, p_name, s_suppkey, p_partkey")
    # Longer joins.
    add("b1", lineitem.filter("l_shipdate", "LTE", timestamp("1998-11-30")).sort("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber").project("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), "SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-11-30' ORDER BY l_returnflag, l_linestatus, l_orderkey, l_linenumber")
    add("b2", part.cross(supplier).cross(lineitem).cross(nation).cross(region).filter(_same("p_partkey", "l_partkey"), _same("s_suppkey", "l_suppkey"), where("p_size", "EQ", i32(15)), _same("s_nationkey", "n_nationkey"), _same("n_regionkey", "r_regionkey"), where("r_name", "EQ", text("EUROPE"))).sort("-s_acctbal", "n_name", "s_name", "p_partkey", "l_suppkey").project("s_acctbal", "s_name", "n_name", "p_partkey", "l_extendedprice"), "SELECT s_acctbal, s_name, n_name, p_partkey, l_extendedprice FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE p_size = 15 AND r_name = 'EUROPE' ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, l_suppkey")
    add("b3", customer.cross(orders).cross(lineitem).filter(where("c_mktsegment", "EQ", text("BUILDING")), _same("c_custkey", "o_custkey"), _same("l_orderkey", "o_orderkey"), where("o_orderdate", "LT", timestamp("1995-03-15")), where("l_shipdate", "GT", timestamp("1995-03-15"))).sort("o_orderdate", "l_orderkey", "l_linenumber").project("l_orderkey", "o_orderdate"), "SELECT l_orderkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' ORDER BY o_orderdate, l_orderkey, l_linenumber")
    add("b4", customer.cross(orders).cross(lineitem).cross(supplier).cross(nation).cross(region).filter(_same("c_custkey", "o_custkey"), _same("l_orderkey", "o_orderkey"), _same("l_suppkey", "s_suppkey"), _same("c_nationkey", "s_nationkey"), _same("s_nationkey", "n_nationkey"), _same("n_regionkey", "r_regionkey"), where("r_name", "EQ", text("ASIA")), where("o_orderdate", "GTE", timestamp("1996-01-01")), where("o_orderdate", "LT", timestamp("1997-01-01"))).sort("-l_extendedprice", "-l_discount", "l_orderkey", "l_linenumber").project("n_name", "l_extendedprice", "l_discount"), "SELECT n_name, l_extendedprice, l_discount FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' ORDER BY l_extendedprice DESC, l_discount DESC, l_orderkey, l_linenumber")
    add("b5", lineitem.filter(where("l_shipdate", "GTE", timestamp("1996-01-01")), where("l_shipdate", "LT", timestamp("1997-01-01")), where("l_discount", "GT", f64(0.05)), where("l_discount", "LT", f64(0.07)), where("l_quantity", "LT", f64(24.0))).sort("l_orderkey", "l_linenumber").project("l_extendedprice", "l_discount"), "SELECT l_extendedprice, l_discount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount > 0.05 AND l_discount < 0.07 AND l_quantity < 24 ORDER BY l_orderkey, l_linenumber")
    add("b6", customer.cross(orders).cross(lineitem).cross(nation).filter(_same("c_custkey", "o_custkey"), _same("l_orderkey", "o_orderkey"), where("o_orderdate", "GTE", timestamp("1995-10-01")), where("o_orderdate", "LT", timestamp("1996-10-01")), where("l_returnflag", "EQ", text("R")), _same("c_nationkey", "n_nationkey")).sort("-l_extendedprice", "-l_discount", "l_orderkey", "l_linenumber").project("c_custkey", "c_name", "l_extendedprice", "l_discount", "c_acctbal", "n_name"), "SELECT c_custkey, c_name, l_extendedprice, l_discount, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-10-01' AND o_orderdate < TIMESTAMP '1996-10-01' AND l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_discount DESC, l_orderkey, l_linenumber")
    add("b7", lineitem.cross(supplier).cross(nation).filter(_same("l_suppkey", "s_suppkey"), _same("s_nationkey", "n_nationkey"), where("n_name", "EQ", text("NATION_7"))).sort("-l_quantity", "l_partkey", "l_suppkey").project("l_partkey", "l_extendedprice", "l_quantity"), "SELECT l_partkey, l_extendedprice, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' ORDER BY l_quantity DESC, l_partkey, l_suppkey")
    add("b8", supplier.cross(nation).cross(lineitem).cross(part).cross(orders).filter(_same("s_nationkey", "n_nationkey"), where("n_name", "EQ", text("NATION_3")), _same("s_suppkey", "l_suppkey"), _same("l_partkey", "p_partkey"), _same("l_orderkey", "o_orderkey")).sort("s_name", "l_orderkey", "l_linenumber").project("s_name", "s_suppkey", "l_partkey", "l_quantity", "o_orderdate"), "SELECT s_name, s_suppkey, l_partkey, l_quantity, o_orderdate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE n_name = 'NATION_3' ORDER BY s_name, l_orderkey, l_linenumber")

    def lines_as(name: str) -> Plan:
        return lineitem.project(*[(c, f"{name}.{c}") for c in ("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")])

    add("b9", supplier.cross(lines_as("l1")).cross(lines_as("l2")).cross(orders).cross(nation).filter(_same("s_suppkey", "l1.l_suppkey"), _same("o_orderkey", "l1.l_orderkey"), where("o_orderstatus", "EQ", text("F")), where("l1.l_discount", "GT", Ref("l1.l_tax")), _same("l2.l_orderkey", "l1.l_orderkey"), where("l2.l_suppkey", "NE", Ref("l1.l_suppkey")), _same("s_nationkey", "n_nationkey"), where("n_name", "EQ", text("NATION_20"))).sort("s_name", "l1.l_orderkey", "l1.l_linenumber", "l2.l_orderkey", "l2.l_linenumber").project("s_name", "l1.l_orderkey", "l1.l_suppkey"), 'SELECT s_name, l1.l_orderkey AS "l1.l_orderkey", l1.l_suppkey AS "l1.l_suppkey" FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN lineitem l2 ON l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = \'F\' AND l1.l_discount > l1.l_tax AND n_name = \'NATION_20\' ORDER BY s_name, l1.l_orderkey, l1.l_linenumber, l2.l_orderkey, l2.l_linenumber')

    def nation_as(name: str) -> Plan:
        return nation.project(*[(c, f"{name}.{c}") for c in ("n_nationkey", "n_name", "n_regionkey")])

    def region_as(name: str) -> Plan:
        return region.project(*[(c, f"{name}.{c}") for c in ("r_regionkey", "r_name")])

    add("b10", customer.cross(orders).cross(lineitem).cross(part).cross(supplier).cross(nation_as("cn")).cross(nation_as("sn")).cross(region_as("cr")).cross(region_as("sr")).filter(_same("c_custkey", "o_custkey"), _same("o_orderkey", "l_orderkey"), _same("l_partkey", "p_partkey"), _same("l_suppkey", "s_suppkey"), _same("c_nationkey", "cn.n_nationkey"), _same("s_nationkey", "sn.n_nationkey"), _same("cn.n_regionkey", "cr.r_regionkey"), _same("sn.n_regionkey", "sr.r_regionkey"), where("c_mktsegment", "EQ", text("BUILDING")), where("l_returnflag", "EQ", text("R")), where("p_size", "GTE", i32(1)), where("p_size", "LTE", i32(25)), where("cr.r_name", "EQ", text("ASIA")), where("sr.r_name", "EQ", text("EUROPE"))).sort("c_custkey", "o_orderdate", "o_orderkey", "l_linenumber").project("c_custkey", "c_name", "o_orderkey", "o_orderdate", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", "cn.n_name", "sn.n_name"), 'SELECT c_custkey, c_name, o_orderkey, o_orderdate, l_linenumber, l_partkey, l_suppkey, p_name, s_name, cn.n_name AS "cn.n_name", sn.n_name AS "sn.n_name" FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey WHERE c_mktsegment = \'BUILDING\' AND l_returnflag = \'R\' AND p_size >= 1 AND p_size <= 25 AND cr.r_name = \'ASIA\' AND sr.r_name = \'EUROPE\' ORDER BY c_custkey, o_orderdate, o_orderkey, l_linenumber')
    # Joins by condition, and each kind of join on request.
    other = supplier.project(("s_suppkey", "t_suppkey"), ("s_acctbal", "t_acctbal"))
    add("theta_lt", supplier.cross(other).filter("s_acctbal", "LT", Ref("t_acctbal")).project("s_suppkey", "t_suppkey"), "SELECT s.s_suppkey, t.s_suppkey AS t_suppkey FROM supplier s JOIN supplier t ON s.s_acctbal < t.s_acctbal")
    add("theta_ne", nation.cross(region).filter("n_regionkey", "NE", Ref("r_regionkey")).project("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey <> r_regionkey")
    add("join_broadcast", q42, sql42, "broadcast")
    add("join_shuffle_hash", q42, sql42, "shuffle_hash")
    add("join_sort_merge", q42, sql42, "merge")
    add("join_nested_loop", q["q36"].plan, q["q36"].sql, "nested_loop")
    # Rewrites.
    add("project_rename_filter", customer.project(("c_custkey", "key"), ("c_acctbal", "balance")).filter("balance", "LT", f64(0.0)), "SELECT c_custkey AS key, c_acctbal AS balance FROM customer WHERE c_acctbal < 0")
    add("project_dup_source", nation.project(("n_name", "a"), ("n_name", "b"), ("n_regionkey", "r")), "SELECT n_name AS a, n_name AS b, n_regionkey AS r FROM nation")
    add("filter_stack", part.filter("p_size", "GT", i32(10)).filter("p_size", "LT", i32(20)).filter("p_retailprice", "GTE", f64(950.0)).project("p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20 AND p_retailprice >= 950")
    add("filter_over_sort", orders.sort("-o_totalprice", "o_orderkey").filter("o_orderstatus", "EQ", text("P")).project("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey")
    add("sort_over_sort", customer.sort("-c_acctbal", "c_custkey").project("c_mktsegment", "c_name").sort("c_mktsegment"), "SELECT c_mktsegment, c_name FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
    add("sort_under_cross", region.cross(nation.sort("-n_name")).filter(_same("r_regionkey", "n_regionkey")).project("r_name", "n_name"), "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
    add("empty_join", part.filter("p_size", "GT", i32(1000)).cross(lineitem).filter(_same("p_partkey", "l_partkey")).project("p_name", "l_orderkey"), "SELECT p_name, l_orderkey FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size > 1000")
    return q


ENTRIES = _entries()


def _runner(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query: Query = from_json(to_json(entry.plan.build()))  # as a client sends it
        tables = Catalog.from_directory(spark, sf_dir, tuple(dict.fromkeys(tables_of(query))))
        return compile_plan(query, tables, spark, strategy=entry.strategy)

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile_orders_totalprice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_table(spark, sf_dir, "orders"), ["o_totalprice"], ProfileSettings(exact_distinct=1 << 40))


def profile_part_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_table(spark, sf_dir, "part"), ["p_size"])


def profile_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(_table(spark, sf_dir, "customer"), ["c_mktsegment"])


def histogram_equi_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equi_depth(_table(spark, sf_dir, "part"), "p_retailprice")


def histogram_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equi_depth(_table(spark, sf_dir, "part"), "p_type")


def physical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    rows = [(c, physically_ordered(orders, c)) for c in ("o_orderkey", "o_orderdate")]
    return spark.createDataFrame(rows, "column_name string, ordered boolean")


def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.floor("s_acctbal").alias("balance")))


def _scratch(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share; on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(shared or tempfile.mkdtemp(prefix='planweave-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as a bar-separated table, and read again by a schema file, through a plan."""
    source = _table(spark, sf_dir, "customer")
    path = _scratch(spark, "pipe")
    write_pipe(source, path)
    columns = columns_of("|".join(source.columns) + "|\nI64|STRING|I32|FLOAT64|STRING|\n")
    tables = Catalog({"customer": TableSpec("customer", path, columns, "pipe")})
    return compile_plan(scan("customer").filter("c_acctbal", "GTE", f64(0.0)), tables, spark)


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a block file, and read again through a catalog of table specifications."""
    source = _table(spark, sf_dir, "part")
    path = _scratch(spark, "blocks")
    write_blocks(source, path)
    tables = Catalog.from_json(Catalog({"part": TableSpec("part", path, tuple(ColumnSpec(f.name, of_spark(f.dataType)) for f in source.schema), "blocks")}).to_specs())
    return compile_plan(scan("part").filter("p_size", "GT", i32(5)), tables, spark)


def block_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of numbers alone, in blocks of 512 bytes."""
    source = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    path = _scratch(spark, "numbers")
    write_blocks(source, path, 512)
    return read_blocks(spark, path, source.schema, 512)


def float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats as text: as they are, far above and far below one, and those that are no numbers."""
    price = F.col("o_totalprice")
    special = F.when(F.col("o_orderkey") % 4 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 4 == 1, F.lit(float("inf"))).when(F.col("o_orderkey") % 4 == 2, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    rows = _table(spark, sf_dir, "orders").filter(price >= 100_000)
    return lines(rows.select("o_orderkey", price, (price * 100_000).alias("large"), (price / -1e9).alias("small"), special.alias("special")))


def _floating(spark: SparkSession, sf_dir: str) -> Catalog:
    x = F.when(F.col("n_nationkey") % 5 == 0, F.lit(float("nan"))).when(F.col("n_nationkey") % 5 == 1, F.lit(0.1)).otherwise(F.col("n_nationkey") / 10 - 1)
    tables = Catalog()
    tables.add("floating", _table(spark, sf_dir, "nation").select("n_nationkey", x.alias("x"), x.cast("float").alias("y"), F.lit(float("nan")).alias("z")))
    return tables


def nan_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is in no order, and unequal to all: rows by the comparisons that they pass."""
    tables, found = _floating(spark, sf_dir), []
    for k, (operator, column, value) in enumerate((("GT", "x", f64(0.0)), ("LTE", "x", f64(0.5)), ("NE", "x", f64(0.1)), ("EQ", "z", Ref("x")), ("NE", "x", Ref("z")), ("GTE", "y", f32(0.1)), ("EQ", "y", f32(0.1)))):
        found.append(compile_plan(scan("floating").filter(column, operator, value).project("n_nationkey"), tables, spark).withColumn("passed", F.lit(k)))
    return reduce(DataFrame.unionByName, found)


def profile_beyond_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values beyond the exact limit are estimated; whether the estimates lie within five standard errors of the counts."""
    s, names = ProfileSettings(exact_distinct=100), ["o_orderkey", "o_totalprice", "o_custkey"]
    rows = _table(spark, sf_dir, "orders")
    found = summary(rows, names, s).select("column_name", "row_count", "min_value", "max_value", "distinct_count")
    exact = rows.agg(*[F.count_distinct(n).alias(n) for n in names]).unpivot([], names, "column_name", "exact")
    return found.join(exact, "column_name").select("column_name", "row_count", "min_value", "max_value", (F.abs(F.col("distinct_count") - F.col("exact")) <= 5 * s.error * F.col("exact")).alias("near"))


def histogram_many_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equi_depth(_table(spark, sf_dir, "customer"), "c_name")


def _summary_sql(table: str, column: str, numeric: bool) -> str:
    low, high = (f"CAST(min({column}) AS DOUBLE)", f"CAST(max({column}) AS DOUBLE)") if numeric else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    return f"SELECT '{column}' AS column_name, count(*) AS row_count, {low} AS min_value, {high} AS max_value, count(DISTINCT {column}) AS distinct_count, CAST(count(DISTINCT {column}) * 1.0 / count(*) AS FLOAT) AS density FROM {table}"


def _histogram_sql(table: str, column: str) -> str:
    return f"SELECT bucket, min(v) AS low, max(v) AS high, count(*) AS frequency FROM (SELECT {column} AS v, CAST(floor((row_number() OVER (ORDER BY {column}) - 1) * 10 / (SELECT count(*) FROM {table})) AS BIGINT) AS bucket FROM {table}) GROUP BY bucket"


_FUNCTIONS = (profile_orders_totalprice, profile_part_size, profile_strings, profile_beyond_exact, histogram_equi_depth, histogram_strings, histogram_many_strings, physical_order, result_text, float_text, pipe_table, block_table, block_numbers, nan_predicates)
_FUNCTION_SQL = {
    "profile_orders_totalprice": _summary_sql("orders", "o_totalprice", True),
    "profile_part_size": _summary_sql("part", "p_size", True),
    "profile_strings": _summary_sql("customer", "c_mktsegment", False),
    "histogram_equi_depth": _histogram_sql("part", "p_retailprice"),
    "histogram_strings": _histogram_sql("part", "p_type"),
    "histogram_many_strings": _histogram_sql("customer", "c_name"),
    "profile_beyond_exact": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, TRUE AS near FROM orders" for c in ("o_orderkey", "o_totalprice", "o_custkey")),
    "float_text": "SELECT o_orderkey || '|' || CAST(o_totalprice AS VARCHAR) || '|' || CAST(o_totalprice * 100000 AS VARCHAR) || '|' || CAST(o_totalprice / -1e9 AS VARCHAR) || '|' || CASE o_orderkey % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE '0.0' END || '|' AS line FROM orders WHERE o_totalprice >= 100000",
    "pipe_table": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal >= 0",
    "block_table": "SELECT * FROM part WHERE p_size > 5",
    "block_numbers": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem",
    "nan_predicates": "WITH f AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 0.1 ELSE n_nationkey / 10 - 1 END AS x FROM nation) SELECT n_nationkey, CAST(k AS INTEGER) AS passed FROM f, range(7) r(k) WHERE CASE k WHEN 0 THEN NOT isnan(x) AND x > 0 WHEN 1 THEN NOT isnan(x) AND x <= 0.5 WHEN 2 THEN isnan(x) OR x <> 0.1 WHEN 3 THEN FALSE WHEN 4 THEN TRUE WHEN 5 THEN NOT isnan(x) AND x::FLOAT >= 0.1::FLOAT ELSE NOT isnan(x) AND x::FLOAT = 0.1::FLOAT END",
    "physical_order": "SELECT 'o_orderkey' AS column_name, count(*) FILTER (WHERE a > o_orderkey) = 0 AS ordered FROM (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY file_row_number) AS a FROM (SELECT o_orderkey, row_number() OVER () AS file_row_number FROM orders)) UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE a > o_orderdate) = 0 FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY file_row_number) AS a FROM (SELECT o_orderdate, row_number() OVER () AS file_row_number FROM orders))",
    "result_text": "SELECT s_suppkey || '|' || s_name || '|' || s_nationkey || '|' || CAST(floor(s_acctbal) AS BIGINT) || '|' AS line FROM supplier",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(e) for name, e in ENTRIES.items()} | {f.__name__: f for f in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items()} | _FUNCTION_SQL
