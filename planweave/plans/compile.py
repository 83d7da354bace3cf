"""Plans to DataFrames. The tree is stated as it is; pushing filters down, pruning columns, turning products into joins, ordering these
and choosing their kind is left to the optimizer and to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planweave.operators.compare import conjunction
from planweave.operators.joins import hinted
from planweave.plans.catalog import Catalog
from planweave.plans.check import output_types
from planweave.plans.plan import Cross, Filter, Plan, PlanError, Project, Query, Scan, Sort
from planweave.plans.types import named

_KEPT = "__kept_order_"


class _Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, ieee_nan: bool, strategy: str | None):
        self.spark, self.catalog, self.ieee_nan, self.strategy = spark, catalog, ieee_nan, strategy

    def make(self, node: Plan, ordered: bool = False) -> tuple[DataFrame, list[tuple[str, bool]]]:
        """The node's rows, and the order they come in, as keys. With ``ordered`` the keys survive projections, as columns that the root drops.

        A sort is stable: over sorted rows, ties keep the order they had. So its keys are followed by the keys of the order below.
        """
        match node:
            case Scan(table):
                return self.catalog.frame(self.spark, table), []
            case Filter(child, predicates):
                df, order = self.make(child, ordered)
                condition = conjunction(predicates, output_types(child, self.catalog), self.ieee_nan)
                return (df if condition is None else df.filter(condition)), order
            case Project(child, columns):
                df, order = self.make(child, ordered)
                kept = [named(name).alias(f"{_KEPT}{k}") for k, (name, _) in enumerate(order)] if ordered else []
                out = df.select(*[named(source).alias(to) for source, to in columns], *kept)
                return out, [(f"{_KEPT}{k}", up) for k, (_, up) in enumerate(order)] if ordered else []
            case Sort(child, keys):
                df, below = self.make(child, True)
                order = [*keys, *(k for k in below if k[0] not in {name for name, _ in keys})]
                return df.orderBy(*[named(name).asc() if up else named(name).desc() for name, up in order]) if order else df, order
            case Cross(left, right):
                return self.make(left)[0].crossJoin(hinted(self.make(right)[0], self.strategy)), []
        raise PlanError(f"not a plan node: {node!r}")


def compile_plan(query: Query | Plan, catalog: Catalog, spark: SparkSession, ieee_nan: bool = True, strategy: str | None = None) -> DataFrame:
    """The DataFrame of a checked plan. ``strategy`` asks for one kind of join everywhere (see ``operators.joins``)."""
    root = query.root if isinstance(query, Query) else query
    types = output_types(root, catalog)
    df, _ = _Compiler(spark, catalog, ieee_nan, strategy).make(root)
    return df if df.columns == list(types) else df.select(*map(named, types))
