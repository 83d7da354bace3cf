"""Column statistics: rows, range, distinct values, density, equi-depth histogram, physical order.

All are aggregates that combine before the shuffle. Where ranks are needed, values are counted first and ranked inside ranges whose bounds
come from approximate percentiles, so no window spans the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.plans.catalog import Catalog
from planweave.plans.types import named


@dataclass(frozen=True)
class ProfileSettings:
    #: Distinct values up to which they are counted exactly, and the relative error beyond.
    exact_distinct: int = 10_000
    error: float = 1.04 / 4096**0.5
    buckets: int = 10
    #: Strings get a histogram only up to so many distinct values.
    string_values: int = 50
    #: Ranges in which ranks and neighbours are looked for.
    ranges: int = 64
    rows_per_range: int = 1_000_000


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def summary(df: DataFrame, columns: list[str] | None = None, settings: ProfileSettings | None = None) -> DataFrame:
    """column_name, row_count, min_value, max_value (numbers only, as double), distinct_count, density: one row per column, from one pass, and
    one more for the columns whose distinct values are few enough to count exactly."""
    s = settings or ProfileSettings()
    names = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema}
    aggregates = [F.count("*").alias("n")]
    for k, name in enumerate(names):
        c = named(name)
        aggregates.append(F.approx_count_distinct(c, s.error).alias(f"d{k}"))
        if _numeric(kinds[name]):
            aggregates += [F.min(c).cast("double").alias(f"lo{k}"), F.max(c).cast("double").alias(f"hi{k}")]
    row = df.agg(*aggregates).first().asDict()
    few = [k for k in range(len(names)) if row[f"d{k}"] <= s.exact_distinct * (1 + 4 * s.error)]
    exact = df.agg(*[F.count_distinct(named(names[k])).alias(f"d{k}") for k in few]).first().asDict() if few else {}
    n = row["n"]
    rows = []
    for k, name in enumerate(names):
        distinct = exact[f"d{k}"] if exact.get(f"d{k}", s.exact_distinct + 1) <= s.exact_distinct else row[f"d{k}"]
        density = min(1.0, distinct / n) if n else None
        rows.append((name, n, row.get(f"lo{k}"), row.get(f"hi{k}"), distinct, density))
    return df.sparkSession.createDataFrame(rows, "column_name string, row_count long, min_value double, max_value double, distinct_count long, density float")


def equi_depth(df: DataFrame, column: str, settings: ProfileSettings | None = None) -> DataFrame:
    """bucket, low, high, frequency: buckets of equally many rows in ascending order, exact; bucket b of k holds the ranks from b*n/k to (b+1)*n/k."""
    s = settings or ProfileSettings()
    c = named(column)
    counts = df.filter(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("c"))
    n = counts.agg(F.sum("c")).first()[0] or 0
    if isinstance(df.schema[column].dataType, T.NumericType):
        bounds = sorted(set(counts.agg(F.percentile_approx("v", [k / s.ranges for k in range(1, s.ranges)], 10_000)).first()[0] or []))
    else:  # the quantiles of some values, those of the least hashes
        drawn = sorted(r["v"] for r in counts.select("v").orderBy(F.xxhash64("v")).limit(64 * s.ranges).collect())
        bounds = sorted({drawn[k * len(drawn) // s.ranges] for k in range(1, s.ranges)}) if drawn else []
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("v"))) if bounds else F.lit(0)
    ranged = counts.withColumn("range", place)
    heads = ranged.groupBy("range").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(F.broadcast(heads.select("range", "base")), "range").withColumn("first", F.col("base") + F.col("before"))
    k, total = F.lit(s.buckets), F.lit(n)
    low = F.floor(F.col("first") * k / total)
    high = F.floor((F.col("first") + F.col("c") - 1) * k / total)
    spread = ranked.withColumn("bucket", F.explode(F.sequence(low, high)))
    begin, end = F.ceil(F.col("bucket") * total / k), F.ceil((F.col("bucket") + 1) * total / k)
    share = F.least(F.col("first") + F.col("c"), end) - F.greatest(F.col("first"), begin)
    return spread.withColumn("share", share).filter("share > 0").groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("share").alias("frequency"))


def physically_ordered(df: DataFrame, column: str, settings: ProfileSettings | None = None) -> bool:
    """Whether a Parquet table's column never descends in file order (files by name). Neighbours are compared inside ranges of rows, then ranges by their ends."""
    s = settings or ProfileSettings()
    spread = F.floor(F.col("_metadata.row_index") / s.rows_per_range)
    rows = df.select(F.col("_metadata.file_path").alias("file"), spread.alias("range"), F.col("_metadata.row_index").alias("at"), named(column).alias("v"))
    before = F.lag("v").over(Window.partitionBy("file", "range").orderBy("at"))
    ranges = rows.withColumn("falls", before > F.col("v")).groupBy("file", "range").agg(F.max(F.coalesce("falls", F.lit(False))).alias("falls"), F.min_by("v", "at").alias("first"), F.max_by("v", "at").alias("last"))
    ends = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("file", "range"))  # one row per range
    return not ranges.withColumn("falls", F.col("falls") | F.coalesce(ends > F.col("first"), F.lit(False))).agg(F.max("falls")).first()[0]


def sample(df: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``rows`` rows: the least random keys."""
    return df.withColumn("__key", F.rand(seed)).orderBy("__key").limit(rows).drop("__key")


def profile_table(catalog: Catalog, df: DataFrame, name: str, settings: ProfileSettings | None = None) -> dict[str, dict[str, Any]]:
    """Statistics of all comparable columns of a table, put into the catalog. Row and distinct counts are kept apart."""
    s = settings or ProfileSettings()
    names = [c.name for c in catalog.tables[name].columns if c.type]
    kinds = {f.name: f.dataType for f in df.schema}
    stats: dict[str, dict[str, Any]] = {}
    total = 0
    for r in summary(df, names, s).collect():  # one row per column
        own: dict[str, Any] = {"distinct": r["distinct_count"], "density": r["density"]}
        if r["min_value"] is not None:
            own["range"] = [r["min_value"], r["max_value"]]
        column = r["column_name"]
        if _numeric(kinds[column]) or (isinstance(kinds[column], T.StringType) and r["distinct_count"] <= s.string_values):
            own["histogram"] = [[h["low"], h["high"], h["frequency"]] for h in sorted(equi_depth(df, column, s).collect(), key=lambda h: h["bucket"])]
        if df.inputFiles() and df.inputFiles()[0].endswith(".parquet"):
            own["ordered"] = physically_ordered(df, column, s)
        stats[column], total = own, r["row_count"]
    catalog.with_stats(name, total, stats)
    return stats
