"""Filter words to Columns. Negated words keep unknown rows, every other comparison drops them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticError

ALIASES = {"=": "is", "==": "is", "eq": "is", "in": "is", "!=": "not", "<>": "not", "neq": "not", "not in": "not", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
TEXT = {"contains": Column.contains, "starts_with": Column.startswith, "ends_with": Column.endswith}
RANGES = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
COMPLEMENTS = {"is": "not", "not": "is", **{w: f"not_{w}" for w in TEXT}, **{f"not_{w}": w for w in TEXT}}
WORDS = ("is", "not", *RANGES, *TEXT, *(f"not_{w}" for w in TEXT), "missing")


def condition(column: Column, word: str, value) -> Column:
    """One filter word on one column. Text words ignore case and take their value literally."""
    word = ALIASES.get(word, word)
    many = value if isinstance(value, (list, tuple)) else [value]
    if word not in WORDS:
        raise SemanticError("INVALID_QUERY", f"unknown filter word {word!r}", allowed=WORDS)
    if word == "missing":
        if not isinstance(value, bool):
            raise SemanticError("INVALID_QUERY", "missing takes true or false")
        return column.isNull() if value else column.isNotNull()
    if any(v is None for v in many) or not many:
        raise SemanticError("INVALID_QUERY", f"{word} can't take null; write missing")
    if word == "is":
        return column.isin(*many) if len(many) > 1 else column == many[0]
    if word == "not":
        return ~(column.isin(*many) if len(many) > 1 else column == many[0]) | column.isNull()
    if word in RANGES:
        if len(many) != 1:
            raise SemanticError("INVALID_QUERY", f"{word} takes one value")
        return RANGES[word](column, F.lit(many[0]))
    if unstable := [v for v in many if (s := str(v)).lower() != s.upper().lower() or len(s.lower()) != len(s)]:
        raise SemanticError("INVALID_QUERY", f"{unstable}: letters whose case isn't stable")
    text, positive = F.lower(column.cast("string")), word.removeprefix("not_")
    found = reduce(Column.__or__, [TEXT[positive](text, str(v).lower()) for v in many])
    return ~found | column.isNull() if word.startswith("not_") else found


def check_strings(value, path: str = "call") -> None:
    """NUL and lone surrogates aren't text."""
    if isinstance(value, str):
        if any(c == "\0" or "\ud800" <= c <= "\udfff" for c in value):
            raise SemanticError("INVALID_QUERY", f"{path} isn't text")
    elif isinstance(value, dict):
        for k, v in value.items():
            check_strings(k, path)
            check_strings(v, f"{path}.{k!r}")
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            check_strings(v, f"{path}[{i}]")
