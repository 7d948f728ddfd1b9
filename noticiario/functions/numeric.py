"""Numbers as spreadsheets spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticiario.functions.text import strip


def parse_numeric(c: Column, stripped: bool = False) -> Column:
    """A number from its many spellings, as double; null where there is none.

    With an exponent a comma is a decimal point. With both separators the last one is the decimal
    point. A lone kind of separator groups thousands when it comes more than once, or once before
    exactly three digits (unless the number starts with ``0`` and that separator); else it is the decimal
    point. Words that float parsers take (inf, nan, 1_000) are no numbers here.
    """
    s = F.lower(strip(c))
    dot, comma = F.instr(s, "."), F.instr(s, ",")
    commas, dots = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    no_dots, no_commas = F.replace(s, F.lit("."), F.lit("")), F.replace(s, F.lit(","), F.lit(""))
    comma_as_dot = lambda x: F.replace(x, F.lit(","), F.lit("."))
    last_comma = s.rlike(",[^.]*$")
    plain = (
        F.when(s.contains("e"), comma_as_dot(s))
        .when((dot > 0) & (comma > 0), F.when(last_comma, comma_as_dot(no_dots)).otherwise(no_commas))
        .when(comma > 0, F.when((commas > 1) | (s.rlike("^[^,]*,[^,]{3}$") & ~s.startswith("0,")), no_commas).otherwise(comma_as_dot(s)))
        .when(dot > 0, F.when((dots > 1) | (s.rlike("^[^.]*[.][^.]{3}$") & ~s.startswith("0.")), no_dots).otherwise(s))
        .otherwise(s)
    )
    return F.regexp_extract(plain, "^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:e[+-]?[0-9]+)?)$", 1).try_cast("double")


def whole_number(s: Column, x: Column) -> Column:
    """The whole number of a cell, as bigint, from its stripped text and its :func:`parse_numeric`; null where it is none or doesn't fit."""
    return F.when(s.rlike("^[0-9]+$"), s.try_cast("bigint")).when((x == F.floor(x)) & (F.abs(x) < 2.0**53), x.try_cast("bigint"))
