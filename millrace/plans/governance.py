"""What a caller may ask: views without hidden objects, rules on how a measure or metric is cut, and names that can't be borrowed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from ..errors import SemanticError
from ..functions.words import ALIASES
from .model import Package

RULES = {"allowed_group_by", "required_group_by", "allowed_where", "required_where", "allowed_clocks", "allow_metric_filters"}


def ids_of(e: object) -> Iterator[str]:
    """Every object that an expression or condition names."""
    if isinstance(e, dict):
        if isinstance(e.get("id"), str):
            yield e["id"]
        for v in e.values():
            yield from ids_of(v)
    elif isinstance(e, (list, tuple)):
        for v in e:
            yield from ids_of(v)


def visible(package: Package, hidden: set[str]) -> Package:
    """The package without some objects and all that is computed from them; to its caller they don't exist."""
    gone = set(hidden)
    gone |= {n for n, m in package.measures.items() if m.clock in gone or m.lookup and m.lookup[1] in gone}
    while more := {n for n, e in package.metrics.items() if n not in gone and gone & set(ids_of(e))}:
        gone |= more
    keep = lambda d: {n: v for n, v in d.items() if n not in gone}
    rollups = tuple(r for r in package.rollups if not gone & {*r.measures, *r.dimensions, r.clock})
    return replace(package, dimensions=keep(package.dimensions), clocks=keep(package.clocks), measures=keep(package.measures), metrics=keep(package.metrics), rollups=rollups)


def check_names(package: Package, select: list) -> None:
    """An output can't take the name of another object."""
    for x in select:
        alias = x.get("as") if isinstance(x, dict) else None
        if alias and alias != x.get("id") and any(alias in d for d in (package.measures, package.metrics, package.dimensions)):
            raise SemanticError("OUTPUT_NAME_GOVERNED", f"{alias} is the name of another object")


def check_constraints(package: Package, call: dict, read: set[str]) -> None:
    """read: the measures and metrics that the call's items come down to. A rule binds every item that reads what it governs."""
    time, groups, where = call.get("time") or {}, call.get("group_by", []), call.get("where", [])
    inline = [c for x in call.get("select", []) if isinstance(x, dict) for c in _conditions(x)]
    asked = [*where, *inline]
    for name in sorted(read & set(package.constraints)):
        rule = package.constraints[name]
        if unknown := set(rule) - RULES:
            raise SemanticError("INVALID_QUERY", f"no rule {sorted(unknown)}", allowed=sorted(RULES))
        deny = lambda what, name=name, **d: SemanticError("POLICY_DENIED", f"{name}: {what}", **d)
        if "allowed_group_by" in rule and (bad := set(groups) - set(rule["allowed_group_by"])):
            raise deny(f"can't be grouped by {sorted(bad)}", allowed=rule["allowed_group_by"])
        if missing := set(rule.get("required_group_by", ())) - set(groups):
            raise deny(f"must be grouped by {sorted(missing)}")
        if "allowed_where" in rule and (bad := {i for c in asked for i in ids_of({k: v for k, v in c.items() if k != "having"})} - set(rule["allowed_where"])):
            raise deny(f"can't be filtered by {sorted(bad)}", allowed=rule["allowed_where"])
        for need in rule.get("required_where", ()):
            word = lambda c: ALIASES.get(c.get("word", "is"), c.get("word", "is"))
            if not any(c.get("id") == need["id"] and word(c) == word(need) and ("value" not in need or c.get("value") == need["value"]) for c in where):
                raise deny(f"needs a filter on {need['id']}")
        clock = time.get("clock") or getattr(package.measures.get(name), "clock", None)
        if "allowed_clocks" in rule and time and clock not in rule["allowed_clocks"]:
            raise deny(f"can't be dated by {clock}", allowed=rule["allowed_clocks"])
        if not rule.get("allow_metric_filters", True) and (inline or call.get("having") or any("having" in c for c in where)):
            raise deny("can't be cut by having, thresholds or filters of an expression")


def _conditions(e: object) -> Iterator[dict]:
    """Filters that the caller writes inside an expression."""
    if isinstance(e, dict):
        for k, v in e.items():
            if k in ("where", "if"):
                yield from v
            else:
                yield from _conditions(v)
    elif isinstance(e, (list, tuple)):
        for v in e:
            yield from _conditions(v)
