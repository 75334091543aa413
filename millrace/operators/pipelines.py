"""Relation pipelines: named steps from tables to a derived relation."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticError
from ..functions.scalars import date_diff
from ..functions.words import condition


def _on(left: DataFrame, right: DataFrame, on: list[dict], *names: str):
    terms = []
    for o in on:
        a, b = (F.col(f"{names[0]}.{o['left']}"), F.col(f"{names[1]}.{o.get('right', o['left'])}")) if names else (left[o["left"]], right[o.get("right", o["left"])])
        if o.get("transform") == "lower":
            a, b = F.lower(a), F.lower(b)
        if "date_lag" in o:
            lag = date_diff(o["date_lag"]["unit"], b, a)
            terms.append((lag >= 0) & (lag <= o["date_lag"]["max"]))
            continue
        terms.append({"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[o.get("op", "=")])
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def _grouped(df: DataFrame, step: dict) -> DataFrame:
    one = lambda c: F.when(F.min(c) == F.max(c), F.max(c))
    fns = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "single_value": one}
    aggs = [(F.count_distinct(F.expr(a["expr"])) if a.get("distinct") else fns[a["fn"]](F.expr(a.get("expr", "1")))).alias(n) for n, a in step["aggregates"].items()]
    return df.groupBy(*step["dimensions"]).agg(*aggs)


def _spine_ends(start, end, max_days: int) -> tuple[date, date]:
    try:
        first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    except ValueError as e:
        raise SemanticError("INVALID_CONFIG", "date_spine start and end must be ISO dates") from e
    if last < first:
        raise SemanticError("INVALID_CONFIG", "date_spine end must be on or after start")
    if (last - first).days + 1 > max_days:
        raise SemanticError("INVALID_CONFIG", f"date_spine exceeds max_days={max_days}")
    return first, last


def run_pipeline(spark, relation, steps: list[dict]) -> DataFrame:
    """Each step is a dict with one key. Conditions of where are {"column", "word", "value"} or SQL text."""
    df: DataFrame | None = None
    grain: set[str] | None = None
    for i, step in enumerate(steps):
        (kind, s), *more = step.items()
        bounded = i == 1 and "date_spine" in steps[0]  # df is at most max_days rows
        if more:
            raise SemanticError("INVALID_QUERY", "a step has one key")
        if kind == "source":
            df = relation(s["relation"]).select(*s.get("columns", ["*"]))
        elif kind == "date_spine":
            start, end = _spine_ends(s["start"], s["end"], s.get("max_days", 3660))
            df = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias(s.get("column", "day")))
        elif kind == "union_all":
            names = s.get("as") or s["branches"][0]["columns"]
            if any(len(b["columns"]) != len(names) for b in s["branches"]) or "as" not in s and any(b["columns"] != names for b in s["branches"]):
                raise SemanticError("INVALID_CONFIG", "branches of union_all list the same columns in one order, or `as` names them")
            df = reduce(DataFrame.unionByName, [relation(b["relation"]).select(*[F.col(c).alias(n) for c, n in zip(b["columns"], names, strict=True)]) for b in s["branches"]])
        elif kind == "select":
            df = df.select(*[F.expr(e).alias(a) for a, e in s["columns"].items()])
        elif kind == "where":
            for c in s:
                df = df.where(c) if isinstance(c, str) else df.where(condition(F.col(c["column"]), c.get("word", "is"), c["value"]))
        elif kind == "json_extract":
            df = df.withColumn(s["as"], F.get_json_object(s["column"], "$." + ".".join(s["path"])))
        elif kind == "explode":
            parts = F.split(s["column"], "\\Q" + s["delimiter"] + "\\E") if "delimiter" in s else F.col(s["column"])
            df = df.select(*[c for c in df.columns if c != s["column"]], F.explode(parts).alias(s["as"]))
        elif kind == "group_by":
            df, grain = _grouped(df, s), set(s["dimensions"])
        elif kind == "join":
            other = relation(s["relation"])
            if "pre_aggregate" in s:
                other = _grouped(other, s["pre_aggregate"])
            elif s.get("require_pre_aggregate"):
                raise SemanticError("INVALID_CONFIG", "the join needs a pre_aggregate of its right side")
            if grain is not None and (off := {o["left"] for o in s["on"]} - grain):
                raise SemanticError("INVALID_CONFIG", f"{sorted(off)} isn't a dimension of the group_by before")
            # both sides can be named: left.x and right.x
            df, other = df.alias("left"), other.alias("right")
            df = df.join(other, _on(df, other, s["on"], "left", "right"), s.get("type", "inner")).select(*[F.expr(e).alias(a) for a, e in s["select"].items()])
        elif kind in ("semi_join", "anti_join", "exclude"):
            other = relation(s["relation"])
            for c in s.get("where", []):
                other = other.where(c)
            df = df.join(other, _on(df, other, s["on"]), "left_semi" if kind == "semi_join" else "left_anti")
        elif kind == "window":
            for alias, w in s.items():
                over = " ".join(filter(None, [f"PARTITION BY {', '.join(w['partition_by'])}" if w.get("partition_by") else "", f"ORDER BY {', '.join(w['order_by'])}" if w.get("order_by") else "", w.get("frame", "")]))
                if unsafe := [x for x in (*w.get("partition_by", []), *w.get("order_by", []), w.get("expr", ""), w.get("frame", "")) if ";" in x or ")" in x.replace("()", "") and x.count("(") != x.count(")")]:
                    raise SemanticError("INVALID_EXPRESSION_AST", f"{unsafe} isn't one expression")
                if w["function"] not in ("row_number", "rank", "dense_rank", "lag", "lead", "sum", "avg", "min", "max", "count", "first_value", "last_value"):
                    raise SemanticError("INVALID_EXPRESSION_AST", f"no window function {w['function']}")
                df = df.withColumn(alias, F.expr(f"{w['function']}({w.get('expr', '')}) OVER ({over})"))
        elif kind == "state_as_of":
            other = relation(s["relation"])
            day = df[s["spine"]]
            inside = (other[s["valid_from"]] <= day) & (other[s["valid_to"]].isNull() | (other[s["valid_to"]] > day))
            if s.get("on"):  # keys that a row of the spine and a state share
                inside = inside & _on(df, other, s["on"])
            kept = [df[c] for c in dict.fromkeys([s["spine"], *(o["left"] for o in s.get("on", []))])]
            spine = F.broadcast(df) if bounded else df
            df = spine.join(other, inside).select(*kept, *[other[c] for c in s["columns"]])
        elif kind == "attribution_join":
            other = relation(s["relation"])
            lag = date_diff(s["lookback"]["unit"], df[s["base_time"]], other[s["attributed_time"]])
            hit = _on(df, other, s["on"]) & (other[s["attributed_time"]] >= df[s["base_time"]]) & (lag <= s["lookback"]["value"])
            df = df.join(other, hit, "left").select(*[F.expr(e).alias(a) for a, e in s["select"].items()])
        else:
            raise SemanticError("INVALID_QUERY", f"no pipeline step {kind}")
    return df
