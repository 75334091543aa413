"""Which joins lead from one entity to another; refuses where several could and nothing decides."""

from __future__ import annotations

from ..errors import SemanticError
from .model import Package, Relationship


def lookups(package: Package, start: str, goal: str) -> list[tuple[Relationship, ...]]:
    """All simple chains of to-one hops within the hop limit."""
    found, todo = [], [((), (start,))]
    while todo:
        path, seen = todo.pop()
        if seen[-1] == goal and path:
            found.append(path)
            continue
        if len(path) < package.max_hops:
            todo += [((*path, r), (*seen, r.target)) for r in package.relationships if r.source == seen[-1] and r.target not in seen]
    return sorted(found, key=lambda p: (len(p), [r.target for r in p]))


def route(package: Package, start: str, goal: str, asked: dict | None = None) -> tuple[Relationship, ...]:
    """The query's own route, then a recorded one, then the direct key, then the only one; else a refusal."""
    if start == goal:
        return ()
    found = lookups(package, start, goal)
    named = {tuple(r.target for r in p): p for p in found}
    for via in ((asked or {}).get(f"{start}->{goal}"), package.preferences.get((start, goal))):
        if via is not None:
            if tuple(via) not in named:
                raise SemanticError("PATH_NOT_FOUND", f"no route {start} -> {' -> '.join(via)}")
            return named[tuple(via)]
    direct = [p for p in found if len(p) == 1]
    if len(direct) == 1:
        return direct[0]
    if not found:
        raise SemanticError("PATH_NOT_FOUND", f"{goal} can't be looked up from {start}")
    if len(found) > 1:
        raise SemanticError("AMBIGUOUS_PATH", f"{len(found)} routes lead from {start} to {goal}", options=[list(k) for k in named])
    return found[0]


def child_route(package: Package, parent: str, child: str, asked: dict | None = None) -> tuple[Relationship, ...]:
    """The to-one chain from a child back to its parent, none of whose hops may be walked forward only."""
    try:
        found = route(package, child, parent, asked)
        if any(r.forward for r in found):
            raise SemanticError("PATH_NOT_FOUND", f"{parent} isn't read by its {child}")
        return found
    except SemanticError as e:
        if e.code == "PATH_NOT_FOUND":
            raise SemanticError("PATH_NOT_FOUND", f"{parent} and {child} aren't related") from None
        raise
