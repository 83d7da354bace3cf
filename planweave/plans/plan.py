"""Plan nodes, their fluent builder and their JSON form.

A plan is a tree of Scan, Filter, Project, Sort and Cross. Joins are filters over Cross.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from planweave.plans.types import OF_JSON, TYPES, Literal, Ref

OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE")
_SIGNS = dict(zip(("==", "!=", ">", ">=", "<", "<="), OPERATORS, strict=True)) | {"=": "EQ", "<>": "NE"}


class PlanError(ValueError):
    """A plan that cannot be read, or does not fit its tables."""


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: Literal | Ref

    def __post_init__(self) -> None:
        object.__setattr__(self, "operator", _SIGNS.get(self.operator, self.operator))
        if self.operator not in OPERATORS:
            raise PlanError(f"unknown operator {self.operator!r}")
        if not isinstance(self.value, Literal | Ref):
            raise PlanError(f"the operand of {self.column!r} is neither a typed literal nor a column")


def where(column: str, operator: str, value: Literal | Ref) -> Predicate:
    return Predicate(column, operator, value)


class Plan:
    """What all nodes have: the builder."""

    def filter(self, *predicates: Predicate | str | Literal | Ref) -> Filter:
        """All of the predicates; one may be given as column, operator, value."""
        if predicates and isinstance(predicates[0], str):
            return Filter(self, (Predicate(*predicates),))
        return Filter(self, tuple(predicates))

    def project(self, *columns: str | tuple[str, str], **renamed: str) -> Project:
        """Columns by name, (from, to) pairs, or to=from, in that order; a source may be repeated."""
        pairs = [(c, c) if isinstance(c, str) else tuple(c) for c in columns]
        return Project(self, tuple(pairs) + tuple((source, name) for name, source in renamed.items()))

    def cross(self, right: Plan) -> Cross:
        return Cross(self, right)

    def sort(self, *keys: str | tuple[str, bool]) -> Sort:
        """Keys by name; ``-name`` or (name, False) descends."""
        return Sort(self, tuple((k.lstrip("-"), not k.startswith("-")) if isinstance(k, str) else tuple(k) for k in keys))

    def build(self) -> Query:
        return Query(self)


@dataclass(frozen=True)
class Scan(Plan):
    table: str


@dataclass(frozen=True)
class Filter(Plan):
    child: Plan
    predicates: tuple[Predicate, ...]


@dataclass(frozen=True)
class Project(Plan):
    child: Plan
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Sort(Plan):
    child: Plan
    keys: tuple[tuple[str, bool], ...]


@dataclass(frozen=True)
class Cross(Plan):
    left: Plan
    right: Plan


@dataclass(frozen=True)
class Query:
    root: Plan


def scan(table: str) -> Scan:
    return Scan(table)


def tables_of(plan: Plan | Query) -> list[str]:
    """The tables a plan scans, as often as it does."""
    match plan:
        case Query(root):
            return tables_of(root)
        case Scan(table):
            return [table]
        case Cross(left, right):
            return tables_of(left) + tables_of(right)
        case Filter(child, _) | Project(child, _) | Sort(child, _):
            return tables_of(child)
    raise PlanError(f"not a plan node: {plan!r}")


def _value_out(v: Literal | Ref) -> dict[str, Any]:
    return {"Column": v.name} if isinstance(v, Ref) else {TYPES[v.type][1]: v.value}


def _out(node: Plan) -> dict[str, Any]:
    match node:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(child, predicates):
            return {"Filter": {"predicates": [{"column_name": p.column, "operator": p.operator, "value": _value_out(p.value)} for p in predicates], "underlying": _out(child)}}
        case Project(child, columns):
            return {"Project": {"column_name_map": [list(c) for c in columns], "underlying": _out(child)}}
        case Sort(child, keys):
            return {"Sort": {"sort_specs": [{"column_name": k, "ascending": up} for k, up in keys], "underlying": _out(child)}}
        case Cross(left, right):
            return {"Cross": {"left": _out(left), "right": _out(right)}}
    raise PlanError(f"not a plan node: {node!r}")


def to_json(query: Query, indent: int | None = None) -> str:
    return json.dumps({"root": _out(query.root)}, indent=indent)


def _only(value: Any, what: str) -> tuple[str, Any]:
    if not isinstance(value, dict) or len(value) != 1:
        raise PlanError(f"{what} must be an object with one key")
    return next(iter(value.items()))


def _value_in(value: Any) -> Literal | Ref:
    key, v = _only(value, "an operand")
    if key == "Column":
        return Ref(v)
    if key not in OF_JSON:
        raise PlanError(f"unknown operand type {key!r}")
    number = isinstance(v, int | float) and not isinstance(v, bool)
    fits = isinstance(v, str) if key in ("String", "Timestamp") else number and (key[0] == "F" or isinstance(v, int))
    if not fits or (key == "I32" and not -(2**31) <= v < 2**31) or (key == "I64" and not -(2**63) <= v < 2**63):
        raise PlanError(f"{v!r} is not a value of {key}")
    return Literal(OF_JSON[key], float(v) if key[0] == "F" else v)


def _in(value: Any) -> Plan:
    kind, body = _only(value, "a node")
    try:
        match kind:
            case "Scan":
                return Scan(body["table_id"])
            case "Filter":
                return Filter(_in(body["underlying"]), tuple(Predicate(p["column_name"], p["operator"], _value_in(p["value"])) for p in body["predicates"]))
            case "Project":
                return Project(_in(body["underlying"]), tuple((a, b) for a, b in body["column_name_map"]))
            case "Sort":
                return Sort(_in(body["underlying"]), tuple((s["column_name"], bool(s["ascending"])) for s in body["sort_specs"]))
            case "Cross":
                return Cross(_in(body["left"]), _in(body["right"]))
    except (KeyError, TypeError, ValueError) as e:
        raise e if isinstance(e, PlanError) else PlanError(f"a {kind} node is malformed: {e!r}") from e
    raise PlanError(f"unknown node {kind!r}")


def from_json(text: str) -> Query:
    try:
        document = json.loads(text)
    except json.JSONDecodeError as e:
        raise PlanError(f"not JSON: {e}") from e
    if not isinstance(document, dict) or "root" not in document:
        raise PlanError("a query has a root")
    return Query(_in(document["root"]))
