"""Command line: run a plan over a directory of tables, print a plan, or make a catalog with statistics."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from planweave.functions.profile import profile_table
from planweave.plans.catalog import Catalog
from planweave.plans.compile import compile_plan
from planweave.plans.plan import from_json, to_json
from planweave.sources.results import first_difference, result_lines
from planweave.sources.schema_file import discover


def _catalog(spark, directory: str) -> Catalog:
    names = tuple(sorted(p.name.removesuffix(".parquet") for p in Path(directory).glob("*.parquet")))
    return Catalog.from_directory(spark, directory, names) if names else discover(directory)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="planweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a JSON plan and print its rows")
    run.add_argument("plan")
    run.add_argument("--data", required=True, help="folder of Parquet tables, or of bar-separated tables with schema files")
    run.add_argument("--expect", help="a file of lines that must come out")
    commands.add_parser("show", help="print a plan").add_argument("plan")
    made = commands.add_parser("catalog", help="print a catalog with statistics")
    made.add_argument("--data", required=True)
    chosen = parser.parse_args(args)
    if chosen.command == "show":
        print(to_json(from_json(Path(chosen.plan).read_text()), indent=2))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("planweave").getOrCreate()
    catalog = _catalog(spark, chosen.data)
    if chosen.command == "catalog":
        for name in list(catalog.tables):
            profile_table(catalog, catalog.frame(spark, name), name)
        print(catalog.to_json())
        return 0
    lines = result_lines(compile_plan(from_json(Path(chosen.plan).read_text()), catalog, spark))
    if chosen.expect:
        body = (x for x in lines if x not in ("validate", "!"))
        with open(chosen.expect) as wanted:
            if found := first_difference(body, (x.rstrip("\n") for x in wanted)):
                print(f"line {found[0]}: {found[1]!r} instead of {found[2]!r}", file=sys.stderr)
                return 1
        return 0
    for line in lines:
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
