"""Tables by name: where they lie, their columns, and what is known of these."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from planweave.plans.plan import PlanError
from planweave.plans.types import TYPES, named, of_spark


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str | None
    stats: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class TableSpec:
    """``name`` is what a Scan asks for, ``path`` and ``format`` where it lies."""

    name: str
    path: str
    columns: tuple[ColumnSpec, ...]
    format: str = "parquet"
    rows: int | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def types(self) -> dict[str, str | None]:
        return {c.name: c.type for c in self.columns}


class Catalog:
    def __init__(self, tables: dict[str, TableSpec] | None = None, frames: dict[str, DataFrame] | None = None):
        self.tables, self.frames = dict(tables or {}), dict(frames or {})

    @classmethod
    def from_directory(cls, spark: SparkSession, directory: str, names: tuple[str, ...]) -> Catalog:
        """Parquet tables ``name.parquet`` of a directory; their footers give the columns."""
        made = cls()
        for name in names:
            made.add(name, spark.read.parquet(f"{directory}/{name}.parquet"), f"{directory}/{name}.parquet")
        return made

    def add(self, name: str, frame: DataFrame, path: str = "", format: str = "parquet") -> None:
        self.frames[name] = frame
        self.tables[name] = TableSpec(name, path, tuple(ColumnSpec(f.name, of_spark(f.dataType)) for f in frame.schema), format)

    def types(self, name: str) -> dict[str, str | None]:
        if name not in self.tables:
            raise PlanError(f"no table {name!r}; there are {', '.join(sorted(self.tables)) or 'none'}")
        return self.tables[name].types()

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        self.types(name)
        if name not in self.frames:
            spec = self.tables[name]
            if spec.format == "blocks":
                from planweave.sources.blocks import read_blocks

                self.frames[name] = read_blocks(spark, spec.path, self.schema(name), int(spec.options.get("block_size", 4096)))
            elif spec.format == "pipe":
                from planweave.sources.pipe import read_pipe

                self.frames[name] = read_pipe(spark, spec.path, self.schema(name))
            else:
                # Read by its own schema, which may have dates where plans have timestamps.
                self.frames[name] = spark.read.format(spec.format).load(spec.path).select(*[named(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name)])
        return self.frames[name]

    def schema(self, name: str) -> T.StructType:
        unknown = [c.name for c in self.tables[name].columns if c.type is None]
        if unknown:
            raise PlanError(f"columns without a plan type: {', '.join(unknown)}")
        return T.StructType([T.StructField(c.name, TYPES[c.type][0]) for c in self.tables[name].columns])

    def with_stats(self, name: str, rows: int, stats: dict[str, dict[str, Any]]) -> None:
        spec = self.tables[name]
        self.tables[name] = replace(spec, rows=rows, columns=tuple(replace(c, stats=stats.get(c.name, c.stats)) for c in spec.columns))

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()]}, indent=1, default=str)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        if "table_specs" in (held := json.loads(text)):
            return cls({t["name"]: _from_spec(t) for t in held["table_specs"]})
        tables = [TableSpec(**(t | {"columns": tuple(ColumnSpec(**c) for c in t["columns"])})) for t in held["tables"]]
        return cls({t.name: t for t in tables})

    def to_specs(self) -> str:
        """The catalog as ``table_specs``: files with columns whose statistics are tagged values."""
        return json.dumps({"table_specs": [{"name": t.name, "file_id": t.path, "column_specs": [{"column_name": c.name, "data_type": c.type, "stats": _tagged(c, t.rows) or None} for c in t.columns]} for t in self.tables.values()]}, indent=1)


def _bounds(kind: str | None, low: Any, high: Any) -> dict[str, Any]:
    value = int if kind in ("Int32", "Int64") else float if kind in ("Float32", "Float64") else str
    return {"lower_bound": {kind: value(low)}, "upper_bound": {kind: value(high)}}


def _tagged(column: ColumnSpec, rows: int | None) -> list[Any]:
    """Statistics in the tagged form. Unordered columns have no tag for it; the row count stands with every column."""
    stats, out = column.stats, []
    if stats.get("ordered"):
        out.append("IsPhysicallyOrdered")
    if "range" in stats:
        out.append({"RangeStat": _bounds(column.type, *stats["range"])})
    if "histogram" in stats:
        out.append({"HistogramStat": {"frequency_points": [[_bounds(column.type, low, high), n] for low, high, n in stats["histogram"]]}})
    if rows is not None:
        out.append({"CardinalityStat": rows})
    if stats.get("density") is not None:
        out.append({"DensityStat": stats["density"]})
    return out


def _value(tagged: dict[str, Any]) -> Any:
    return next(iter(tagged.values()))


def _from_spec(spec: dict[str, Any]) -> TableSpec:
    """A table of a ``table_specs`` document. Its file is a block file unless its name says otherwise."""
    columns, rows = [], None
    for c in spec["column_specs"]:
        stats: dict[str, Any] = {}
        for stat in c.get("stats") or []:
            tag, body = (stat, None) if isinstance(stat, str) else next(iter(stat.items()))
            match tag:
                case "IsPhysicallyOrdered":
                    stats["ordered"] = True
                case "RangeStat":
                    stats["range"] = [_value(body["lower_bound"]), _value(body["upper_bound"])]
                case "HistogramStat":
                    stats["histogram"] = [[_value(r["lower_bound"]), _value(r["upper_bound"]), n] for r, n in body["frequency_points"]]
                case "CardinalityStat":
                    rows = body
                case "DensityStat":
                    stats["density"] = body
                case _:
                    raise PlanError(f"unknown statistic {tag!r}")
        if c["data_type"] not in TYPES:
            raise PlanError(f"unknown type {c['data_type']!r}")
        columns.append(ColumnSpec(c["column_name"], c["data_type"], stats))
    path = spec["file_id"]
    kind = "parquet" if path.endswith(".parquet") else "pipe" if path.endswith((".csv", ".tbl")) else "blocks"
    return TableSpec(spec["name"], path, tuple(columns), kind, rows)
