"""Column types of plans and their Spark forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Plan type: (Spark type, key of a literal in JSON, token in a schema file). Timestamp extends the five core types, for Parquet tables.
TYPES = {
    "Int32": (T.IntegerType(), "I32", "I32"),
    "Int64": (T.LongType(), "I64", "I64"),
    "Float32": (T.FloatType(), "F32", "FLOAT32"),
    "Float64": (T.DoubleType(), "F64", "FLOAT64"),
    "String": (T.StringType(), "String", "STRING"),
    "Timestamp": (T.TimestampNTZType(), "Timestamp", "TIMESTAMP"),
}
FLOATS = ("Float32", "Float64")
_OF_SPARK = {spark.simpleString(): name for name, (spark, _, _) in TYPES.items()} | {"timestamp": "Timestamp", "date": "Timestamp"}
OF_JSON = {key: name for name, (_, key, _) in TYPES.items()}
OF_TOKEN = {token: name for name, (_, _, token) in TYPES.items()}


def of_spark(kind: T.DataType) -> str | None:
    """The plan type of a Spark type; None for types that plans can carry but not compare."""
    return _OF_SPARK.get(kind.simpleString())


@dataclass(frozen=True)
class Literal:
    type: str
    value: int | float | str

    def column(self) -> Column:
        if self.type == "Timestamp":
            return F.lit(self.value).cast("timestamp_ntz")
        return F.lit(self.value).cast(TYPES[self.type][0])


@dataclass(frozen=True)
class Ref:
    """Another column as the operand of a comparison."""

    name: str


def i32(v: int) -> Literal:
    return Literal("Int32", v)


def i64(v: int) -> Literal:
    return Literal("Int64", v)


def f32(v: float) -> Literal:
    return Literal("Float32", v)


def f64(v: float) -> Literal:
    return Literal("Float64", v)


def text(v: str) -> Literal:
    return Literal("String", v)


def timestamp(v: str) -> Literal:
    """An ISO date or time."""
    return Literal("Timestamp", v)


def named(name: str) -> Column:
    """A column by its whole name; dots and back-ticks in it are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")
