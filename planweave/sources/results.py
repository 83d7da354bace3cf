"""Results as text lines, and their comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import zip_longest

from pyspark.sql import DataFrame

from planweave.functions.text import lines


def result_lines(df: DataFrame) -> Iterator[str]:
    """Lines of a framed result: ``validate``, one line per row, and ``!``. Rows are streamed partition by partition."""
    yield "validate"
    for row in lines(df).toLocalIterator():
        yield row["line"]
    yield "!"


def first_difference(found: Iterator[str], wanted: Iterator[str]) -> tuple[int, str | None, str | None] | None:
    """The first line, counted from 1, in which two sequences differ once trimmed."""
    for k, (a, b) in enumerate(zip_longest(found, wanted), 1):
        if (a is None) != (b is None) or a.strip() != b.strip():
            return k, a, b
    return None


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows as often, in whatever order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
