"""Text tables whose cells are set off, and whose lines end, by a bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.plans.types import named

_BEYOND = "__beyond"


def read_pipe(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows by the declared schema. The bar at the end of a line makes one more, empty column, which is dropped. Empty string cells, the last
    one too, are empty strings; a number that cannot be read, or a missing cell, fails the read."""
    wide = T.StructType([*schema, T.StructField(_BEYOND, T.StringType())])
    raw = spark.read.csv(path, sep="|", quote="", escape="\0", comment="", schema=wide, mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    cells = [F.coalesce(named(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else named(f.name) for f in schema]
    return raw.select(*cells)


def write_pipe(df: DataFrame, path: str) -> None:
    """A folder of text files with a bar after each cell."""
    from planweave.functions.text import lines

    lines(df).write.text(path)
