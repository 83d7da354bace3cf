"""Comparison atoms with the plan's rules for NaN."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave.plans.plan import Predicate
from planweave.plans.types import FLOATS, Ref, named

_APPLY = {
    "EQ": lambda a, b: a == b,
    "NE": lambda a, b: a != b,
    "GT": lambda a, b: a > b,
    "GTE": lambda a, b: a >= b,
    "LT": lambda a, b: a < b,
    "LTE": lambda a, b: a <= b,
}


def atom(p: Predicate, types: dict[str, str | None], ieee_nan: bool = True) -> list[Column]:
    """Conjuncts of one predicate. NaN is unequal to everything and in no order; the plain comparison stays a conjunct of its own, so it is pushed down."""
    left = named(p.column)
    right = named(p.value.name) if isinstance(p.value, Ref) else p.value.column()
    plain = _APPLY[p.operator](left, right)
    if not ieee_nan or types.get(p.column) not in FLOATS:
        return [plain]
    able = [left, right] if isinstance(p.value, Ref) else [left]
    if not isinstance(p.value, Ref) and p.value.value != p.value.value:
        return [F.lit(p.operator == "NE")]
    if p.operator == "NE":
        return [reduce(lambda a, b: a | b, [plain, *map(F.isnan, able)])]
    return [plain, *(~F.isnan(x) for x in able)]


def conjunction(predicates: tuple[Predicate, ...], types: dict[str, str | None], ieee_nan: bool = True) -> Column | None:
    atoms = [c for p in predicates for c in atom(p, types, ieee_nan)]
    return reduce(and_, atoms) if atoms else None
