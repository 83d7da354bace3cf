"""Plans over tables that grow: a plan of scans, filters, projections and products with tables at rest runs on arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planweave.plans.catalog import Catalog
from planweave.plans.compile import compile_plan
from planweave.plans.plan import Cross, Filter, Plan, PlanError, Project, Query, Sort, tables_of


def _sorted(node: Plan) -> bool:
    match node:
        case Sort():
            return True
        case Cross(left, right):
            return _sorted(left) or _sorted(right)
        case Filter(child, _) | Project(child, _):
            return _sorted(child)
    return False


def follow(query: Query, catalog: Catalog, spark: SparkSession, table: str, folder: str, files_at_once: int = 64) -> DataFrame:
    """A streaming DataFrame: the plan with ``table`` read from the Parquet files that come into ``folder``."""
    if _sorted(query.root):
        raise PlanError("a stream has no end and cannot be sorted")
    if tables_of(query).count(table) != 1:
        raise PlanError(f"the plan must scan {table!r} once")
    source = spark.readStream.schema(catalog.frame(spark, table).schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    live = Catalog(catalog.tables, catalog.frames | {table: source})
    return compile_plan(query, live, spark)
