"""Conversion: the share of base events that a later event of the same entity follows within a window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError
from ..functions.scalars import date_add
from ..plans import clock as clocks
from ..plans.leaf import Reader

#: Both count the same base events; a match is the earliest event of the window, which is also the nearest.
MATCHING = ("first_converted_after_base", "closest_converted_after_base")
#: The most days that one unit spans.
DAYS = {"day": 1, "week": 7, "month": 31, "quarter": 92, "year": 366}


def conversion(engine, name: str, r: dict, call: dict) -> DataFrame:
    """base/converted: {"id": measure, "where": [...]}; entity: dimension on both; window {unit, value}; match base <= converted < base + window.

    constant_properties: dimensions, or pairs of a base and a converted one, equal on both events (unknown equals unknown).
    dimension_bindings: {group: "converted"} reads a group from the earliest matching event, ties kept; its rate divides by the base events
    of the base groups beside it. Events meet by entity and slice of time as long as the window, so a busy entity is many keys.
    """
    if "window" not in r:
        raise SemanticError("CONVERSION_NOT_SUPPORTED", "a conversion needs a window")
    if r.get("matching_mode") not in MATCHING:
        raise SemanticError("CONVERSION_MATCHING_MODE_REQUIRED", "state which converted event is matched", allowed=MATCHING)
    sides = []
    for part in (r["base"], r["converted"]):
        m = engine._measure(part["id"])
        reader = Reader(engine.package, engine.relation, m.entity, call.get("routes"))
        t = reader.clock(engine.package.clocks[m.clock])
        reader.where(part.get("where", []))
        sides.append((reader, reader.dimension(r["entity"]), t, m))
    (base, who, when, m), (other, their, at, om) = sides
    base.where(call.get("where", []))
    time = call.get("time") or {}
    if time.get("clock") not in (None, m.clock):
        raise SemanticError("INVALID_TEMPORAL_BINDING", f"a conversion is dated by {m.clock}", allowed=[m.clock])
    start, end, _ = clocks.window(time) if time else (None, None, False)
    for edge, op in ((start, "__ge__"), (end, "__lt__")):
        if edge:
            base.df = base.df.where(getattr(when, op)(F.lit(edge.isoformat()).cast("timestamp_ntz")))
    if not engine.package.entities[m.entity].key:
        raise SemanticError("ROW_GRAIN_UNSUPPORTED", f"{m.entity} has no key")
    keys = [F.col(f"{m.entity}${k}").alias(f"__b{i}") for i, k in enumerate(engine.package.entities[m.entity].key)]
    bound = [g for g in call.get("group_by", []) if r.get("dimension_bindings", {}).get(g) == "converted"]
    groups = [base.dimension(g).alias(g) for g in call.get("group_by", []) if g not in bound]
    if time.get("grain"):
        groups.append(F.date_trunc(time["grain"], when).cast("date").alias("period"))
    pairs = [p if isinstance(p, (list, tuple)) else (p, p) for p in r.get("constant_properties", [])]
    mine = [base.dimension(a).alias(f"__p{i}") for i, (a, _) in enumerate(pairs)]
    theirs = [other.dimension(b).alias(f"__q{i}") for i, (_, b) in enumerate(pairs)]
    far = [other.dimension(g).alias(g) for g in bound]
    n, unit = r["window"]["value"], r["window"]["unit"]
    width = n * DAYS[unit]
    slice_of = lambda t: F.floor(F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")) / width)
    left = base.df.select(*keys, *groups, *mine, who.alias("__who"), when.alias("__t"))
    right = other.df.select(their.alias("__their"), at.alias("__c"), *theirs, *far, slice_of(at).alias("__in")).where("__their is not null and __c is not null").distinct()
    ids = [k for k in left.columns if k.startswith("__b")]
    wide = left.withColumn("__slice", F.explode(F.array(slice_of(F.col("__t")), slice_of(F.col("__t")) + 1)))
    meets = (F.col("__who") == F.col("__their")) & (F.col("__slice") == F.col("__in")) & (F.col("__c") >= F.col("__t")) & (F.col("__c") < date_add(unit, n, F.col("__t")))
    meets = reduce(Column.__and__, [F.col(f"__p{i}").eqNullSafe(F.col(f"__q{i}")) for i in range(len(pairs))], meets)
    by = [c for c in left.columns if not c.startswith("__")]
    if not bound:
        met = wide.join(right, meets, "left_semi").select(*[F.col(k).alias(f"{k}m") for k in ids]).distinct()
        joined = left.join(met, [F.col(c) == F.col(f"{c}m") for c in ids], "left")
        hit = F.count_distinct(*[F.when(F.col(f"{ids[0]}m").isNotNull(), F.col(c)) for c in ids])
        rate = hit.cast("double") / F.nullif(F.count_distinct(*ids).cast("double"), F.lit(0.0))
        return joined.groupBy(*[F.col(f"`{c}`") for c in by]).agg(rate.alias(name), F.count("*").alias(f"{name}n"))
    first = wide.join(right.drop(*bound).distinct(), meets).groupBy(*ids).agg(F.min("__c").alias("__first"))
    again = left.join(first.select(*[F.col(k).alias(f"{k}m") for k in ids], "__first"), [F.col(c) == F.col(f"{c}m") for c in ids])
    same = reduce(Column.__and__, [F.col(f"__p{i}").eqNullSafe(F.col(f"__q{i}")) for i in range(len(pairs))], (F.col("__who") == F.col("__their")) & (F.col("__first") == F.col("__c")))
    out = again.join(right, same).groupBy(*[F.col(f"`{c}`") for c in (*by, *bound)]).agg(F.count_distinct(*ids).alias("__num"))
    whole = left.groupBy(*[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.count_distinct(*ids).alias("__den"))
    if by:
        out = out.join(whole, reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]))
    else:
        out = out.crossJoin(F.broadcast(whole))  # one row
    return out.select(*[F.col(f"`{c}`") for c in (*by, *bound)], (F.col("__num").cast("double") / F.nullif(F.col("__den").cast("double"), F.lit(0.0))).alias(name), F.col("__num").alias(f"{name}n"))
