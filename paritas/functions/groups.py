"""Reading the group field of out-of-domain tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings that stand for "no group", compared in lower case.
NO_GROUP = ("none", "nan", "null", "unknown")

WHITESPACE = " \t\n\r\f\v"


def _bracket_list(value: Column) -> Column:
    """Items of a bracketed list literal; null when it is not a list.

    JSON with single quotes covers the usual case. A second reading allows what
    only Python's notation has: a trailing comma and a bare None.
    """
    python_only = F.regexp_replace(
        F.regexp_replace(value, r",\s*\]$", "]"),
        r"(?<=[\[,]\s{0,8})None(?=\s*[,\]])",
        "null",
    )
    return F.coalesce(
        F.from_json(value, "array<string>"), F.from_json(python_only, "array<string>")
    )


def parse_groups(field: Column, field_type: T.DataType) -> Column:
    """Distinct group names of one row, as an array in order of appearance.

    A bracketed value is a list literal, and stays one verbatim name if it cannot
    be read. Any other string is comma-separated and trimmed; list items are
    not. Names keep their case, so ``black`` and ``Black`` are two groups.
    """
    if isinstance(field_type, T.ArrayType):
        names = field.cast("array<string>")
    else:
        value = field.cast("string")
        names = F.when(
            value.startswith("[") & value.endswith("]"),
            F.coalesce(_bracket_list(value), F.array(value)),
        ).otherwise(F.transform(F.split(value, ","), lambda g: F.btrim(g, F.lit(WHITESPACE))))
    named = F.filter(
        names, lambda g: g.isNotNull() & (g != "") & ~F.lower(g).isin(*NO_GROUP)
    )
    return F.coalesce(F.array_distinct(named), F.array().cast("array<string>"))
