"""The allow-list of scalar calls, each with its meaning fixed: division by zero is null, DATE_DIFF counts boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError


def date_diff(unit: str, a: Column, b: Column) -> Column:
    """Boundaries of the unit between a and b; weeks are whole sevens of days."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    days = F.datediff(b, a)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    quarters = (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    known = {"day": days, "week": (days / 7).cast("int"), "month": months, "quarter": quarters, "year": F.year(b) - F.year(a)}
    return known[unit].cast("long")


def date_add(unit: str, n: int, d: Column) -> Column:
    parts = {"day": F.make_interval(days=F.lit(n)), "week": F.make_interval(weeks=F.lit(n)), "month": F.make_interval(months=F.lit(n)), "quarter": F.make_interval(months=F.lit(3 * n)), "year": F.make_interval(years=F.lit(n))}
    return d + parts[unit]


def divide(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def split(text: Column, by: str) -> Column:
    """Parts between occurrences of a literal text."""
    return F.split(text, "\\Q" + by + "\\E")


_TEXT = lambda c: F.coalesce(c.cast("string"), F.lit(""))
CALLS = {
    "ABS": F.abs, "CEIL": F.ceil, "CEILING": F.ceil, "FLOOR": F.floor, "EXP": F.exp, "LN": F.ln, "LOG": F.log10, "POWER": F.pow, "SQRT": F.sqrt,
    "ROUND": lambda c, n=None: F.round(c, 0 if n is None else n), "CONCAT": lambda *c: F.concat(*map(_TEXT, c)), "LENGTH": F.length, "LOWER": F.lower, "UPPER": F.upper,
    "REPLACE": F.replace, "SUBSTR": F.substr, "SUBSTRING": F.substr, "TRIM": F.trim, "LEFT": F.left, "RIGHT": F.right, "COALESCE": F.coalesce, "NULLIF": F.nullif,
    "DATE_DIFF": date_diff, "DATE_ADD": date_add, "DATE_TRUNC": lambda unit, c: F.date_trunc(unit, c).cast("date"), "DATE_PART": lambda unit, c: F.date_part(F.lit(unit), c).cast("long"),
    "JSON_EXTRACT_STRING": F.get_json_object, "JSON_EXTRACT": F.get_json_object, "SPLIT": split, "STRING_SPLIT": split, "STR_SPLIT": split, "CAST": lambda c, kind: c.cast({"VARCHAR": "string", "INTEGER": "bigint"}.get(kind, kind)),
}
#: Arguments that are plain values rather than columns.
_PLAIN = {"DATE_DIFF": (0,), "DATE_ADD": (0, 1), "DATE_TRUNC": (0,), "DATE_PART": (0,), "JSON_EXTRACT_STRING": (1,), "JSON_EXTRACT": (1,), "SPLIT": (1,), "STRING_SPLIT": (1,), "STR_SPLIT": (1,), "CAST": (1,), "ROUND": (1,)}


def call(name: str, args: list) -> Column:
    if name.upper() not in CALLS:
        raise SemanticError("INVALID_EXPRESSION_AST", f"function {name} isn't allowed", allowed=sorted(CALLS))
    plain = _PLAIN.get(name.upper(), ())
    return CALLS[name.upper()](*[a if i in plain or isinstance(a, Column) else F.lit(a) for i, a in enumerate(args)])
