"""Values as text: whole numbers in decimal, floats in the shortest positional form that reads back, strings as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.plans.types import named

#: The JVM's text of magnitudes below 1e-3 and from 1e7 on: sign, first digit, further digits, exponent.
_EXPONENT = r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$"
#: Decimal forms of at most 15 digits never share a normal double, so only longer ones can have a shorter form.
_SURE_DIGITS = 15
_LEAST_NORMAL = 2.2250738585072014e-308


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _placed(digits: Column, e: Column) -> Column:
    """Digits with their point, the first digit having the place of ten to the power ``e``."""
    large = F.when(F.length(digits) <= e + 1, F.concat(F.rpad(digits, e + 1, F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits))))
    return F.when(e >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))


def _form(text: Column) -> Column:
    """Digits and exponent of the JVM's text of a magnitude."""
    every = F.replace(F.substring_index(text, "E", 1), F.lit("."), F.lit(""))
    power = F.when(F.instr(text, "E") == 0, F.lit(0)).otherwise(F.substring_index(text, "E", -1).cast("int"))
    digits = F.ltrim(every, F.lit("0"))
    return F.struct(F.rtrim(digits, F.lit("0")).alias("digits"), (power + F.instr(text, ".") - 2 - F.length(every) + F.length(digits)).alias("e"))


def _near(form: Column, m: Column) -> Column:
    """The two forms of ``m`` digits next to a longer one, the nearest first, as whole numbers and exponents."""
    cut = F.substring(form["digits"], F.lit(1), m).cast("long")
    up = (F.substring(form["digits"], m + 1, F.lit(1)) >= "5").cast("long")
    return F.transform(F.array(cut + up, cut + 1 - up), lambda d: F.struct(d.cast("string").alias("d"), (form["e"] - m + 1).alias("x")))


def _shortest(size: Column, form: Column) -> Column:
    """The shortest form that reads back as the magnitude ``size``, from one that does. Where no form with one digit less does, no
    shorter one does: of the two next to the given form, one lies between it and any shorter form."""

    def reading_back(forms: Column) -> Column:
        return F.filter(forms, lambda f: F.concat(f["d"], F.lit("E"), f["x"].cast("string")).cast("double") == size)

    n = F.length(form["digits"])
    shorter = F.get(reading_back(F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda m: _near(form, m)))), F.lit(0))
    found = _with(shorter, lambda f: F.struct(F.rtrim(f["d"], F.lit("0")).alias("digits"), (f["x"] + F.length(f["d"]) - 1).alias("e")))
    return F.when((n > 1) & (F.size(reading_back(_near(form, n - 1))) > 0), found).otherwise(form)


def _positional(c: Column) -> Column:
    """The text of a double without an exponent. The JVM's text reads back, but at times has more digits than are needed."""
    s = c.cast("string")
    sign, head, tail, power = (F.regexp_extract(s, _EXPONENT, k) for k in range(1, 5))
    digits = F.concat(head, F.when(tail == "0", F.lit("")).otherwise(tail))
    sure = (F.length(s) <= _SURE_DIGITS + 1) & ((F.abs(c) >= _LEAST_NORMAL) | (c == 0))
    shortest = _with(_with(_form(F.ltrim(s, F.lit("-"))), lambda f: _shortest(F.abs(c), f)), lambda f: _placed(f["digits"], f["e"]))
    longer = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), shortest)
    return F.when(~sure, longer).when(F.instr(s, "E") == 0, s).otherwise(F.concat(sign, _placed(digits, power.cast("int"))))


def _floats(c: Column) -> Column:
    """Null stays null."""
    return F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf")).otherwise(_positional(c))


def as_text(field: T.StructField) -> Column:
    c = named(field.name)
    if isinstance(field.dataType, T.FloatType | T.DoubleType):
        return _floats(c.cast("double"))
    return c.cast("string")


def lines(df: DataFrame) -> DataFrame:
    """One column ``line``: the values of a row, each followed by a bar. A null is empty."""
    cells = [x for f in df.schema for x in (F.coalesce(as_text(f), F.lit("")), F.lit("|"))]
    return df.select(F.concat(*cells).alias("line"))
