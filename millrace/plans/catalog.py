"""What a package offers, as a table and by search."""

from __future__ import annotations

import json
import re
from math import log

from pyspark.sql import DataFrame, SparkSession

from .model import Package


def objects(package: Package) -> list[tuple[str, str, str | None, str]]:
    """(kind, id, entity, detail) of every object that isn't denied."""
    rows = [("entity", n, n, e.table) for n, e in package.entities.items()]
    rows += [("dimension", n, d.entity, d.expr) for n, d in package.dimensions.items()]
    rows += [("clock", n, c.entity, c.column) for n, c in package.clocks.items()]
    rows += [("measure", n, m.entity, m.agg) for n, m in package.measures.items()]
    rows += [("metric", n, None, e if isinstance(e, str) else json.dumps(e, sort_keys=True)) for n, e in package.metrics.items()]
    return [r for r in rows if r[1] not in package.denied]


def catalog(spark: SparkSession, package: Package) -> DataFrame:
    return spark.createDataFrame(objects(package), "kind string, id string, entity string, detail string")


def discover(package: Package, text: str, limit: int = 10) -> list[tuple[str, str]]:
    """(kind, id) of the objects that share most with the text; rare words weigh more, ties go by id."""
    words = lambda s: {w.rstrip("s") for w in re.findall(r"[a-z0-9]+", s.lower())}
    held = [(kind, name, words(f"{name} {entity or ''}")) for kind, name, entity, _ in objects(package)]
    weight = {w: log(1 + len(held) / sum(w in own for *_, own in held)) for w in set().union(*(own for *_, own in held))}
    scored = [(sum(weight[w] for w in own & words(text)) / (1 + len(own)) ** 0.5, kind, name) for kind, name, own in held]
    return [(kind, name) for score, kind, name in sorted(scored, key=lambda s: (-s[0], s[2], s[1])) if score > 0][:limit]


def offers(package: Package, name: str) -> dict:
    """What a measure can be asked with: statistics, clock, and the dimensions that its rows look up."""
    from .routes import lookups

    m = package.measures[name]
    near = {m.entity} | {e for e in package.entities if e != m.entity and lookups(package, m.entity, e)}
    return {"statistics": list(m.allowed), "clock": m.clock, "group_by": sorted(n for n, d in package.dimensions.items() if d.entity in near and n not in package.denied)}
