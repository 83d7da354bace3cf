"""Two-line schema files (names, then types, both set off by bars) and the tables of a directory."""

from __future__ import annotations

import warnings
from pathlib import Path

from pyspark.sql import types as T

from planweave.plans.catalog import Catalog, ColumnSpec, TableSpec
from planweave.plans.plan import PlanError
from planweave.plans.types import OF_TOKEN, TYPES


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().rstrip("|").split("|")]


def columns_of(text: str) -> tuple[ColumnSpec, ...]:
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) < 2:
        raise PlanError("a schema file has a line of names and a line of types")
    names, types = _cells(lines[0]), [t.upper() for t in _cells(lines[1])]
    if len(names) != len(types):
        raise PlanError(f"{len(names)} names, but {len(types)} types")
    if unknown := [t for t in types if t not in OF_TOKEN]:
        raise PlanError(f"unknown types: {', '.join(unknown)}")
    return tuple(ColumnSpec(n, OF_TOKEN[t]) for n, t in zip(names, types, strict=True))


def struct_of(columns: tuple[ColumnSpec, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.name, TYPES[c.type][0]) for c in columns])


def discover(directory: str) -> Catalog:
    """Every ``name.csv`` with a ``name.schema`` beside it. Others are left out with a warning."""
    made = Catalog()
    for path in sorted(Path(directory).glob("*.csv")):
        described = path.with_suffix(".schema")
        if not described.exists():
            warnings.warn(f"{path.name} has no schema file and is left out", stacklevel=2)
            continue
        made.tables[path.stem] = TableSpec(path.stem, str(path), columns_of(described.read_text()), "pipe")
    return made
