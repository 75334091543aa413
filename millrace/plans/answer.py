"""An answer: the rows of a call, and what must be said beside them. Notes come from the plan; only `fetch` runs anything."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from ..errors import SemanticError
from ..functions.words import ALIASES
from . import clock as clocks
from .governance import ids_of

LOOK_BACKS = {"rolling", "prior_period", "cumulative", "period_to_date"}


@dataclass
class Answer:
    rows: DataFrame
    window: dict | None = None
    clock: str | None = None
    routes: dict = field(default_factory=dict)
    notes: list[dict] = field(default_factory=list)

    def codes(self) -> set[str]:
        return {n["code"] for n in self.notes}


def answer(engine, call: dict) -> Answer:
    """The call's rows, window, clocks and notes by code."""
    mine = engine.__class__(engine.spark, engine.package, engine.relation)
    out = Answer(mine.query(call), routes=call.get("routes") or {}, notes=mine.notes)
    if "parts" in call:
        return out
    package, time = engine.package, call.get("time") or {}
    items = [mine._item(x) for x in call.get("select", [])]
    read = {i for _, e in items for i in ids_of(e) if i in package.measures}
    say = lambda code, **d: out.notes.append({"code": code, **d})
    kinds = {k for _, e in items for k in _kinds(e)}
    out.clock = time.get("clock") or next((c for c in (package.measures[i].clock for i in sorted(read)) if c), None) if time else None
    if time:
        start, end, named = clocks.window(time)
        partial = "this" in time or bool(time.get("grain") and any(not clocks.whole(d, time["grain"]) for d in (start, end)))
        out.window = {"start": start, "end": end, "now": time.get("now"), "partial": partial}
        if partial:
            say("PARTIAL_PERIOD")
        if not time.get("grain"):
            say("WINDOW_TOTAL")
        elif not (named or time.get("fill") or kinds & LOOK_BACKS):
            say("OBSERVED_PERIODS_ONLY")
    for alias, e in items:
        m = package.measures.get(e.get("id", ""))
        if m and e.get("agg", m.agg) != m.agg:
            say("AGGREGATION_OVERRIDE", column=alias, agg=e["agg"], default=m.agg)
        if e["kind"] == "measure" and (over := [n for n, x in package.metrics.items() if isinstance(x, dict) and x.get("kind") == "measure" and x.get("id") == e["id"]]):
            say("GOVERNED_METRIC_EXISTS", column=alias, metrics=over)
        if e["kind"] == "share":
            say("SHARE_OF_TOTAL", column=alias, over=e["over"])
        if e["kind"] == "total":
            say("TOTAL_OVER", column=alias, over=e["over"])
        if m and m.stock is not None:
            say("BALANCE_CLOSING_DAY", column=alias, clock=m.clock)
    if call.get("totals"):
        say("TOTALS", over=call["totals"])
    for g in call.get("group_by", []):
        if g in package.dimensions and package.dimensions[g].key:
            say("GROUPED_BY_KEY", group=g, key=package.dimensions[g].key)
    for c in call.get("where", []):
        if "having" in c:
            say("ENTITY_FILTER_OVER", entity=c["entity"], over=c["over"])
        word = ALIASES.get(c.get("word", "is"), c.get("word", "is"))
        if "id" in c and word.startswith("not"):
            say("UNKNOWN_ROWS_KEPT", field=c["id"])
    if not call.get("select"):
        say("LISTED_THROUGH", groups=call.get("group_by", []))
    return out


def _kinds(e: object):
    if isinstance(e, dict):
        if "kind" in e:
            yield e["kind"]
        for v in e.values():
            yield from _kinds(v)
    elif isinstance(e, (list, tuple)):
        for v in e:
            yield from _kinds(v)


def fetch(engine, call: dict, max_rows: int = 10_000, timeout: float | None = None) -> tuple[list[Row], list[dict]]:
    """Rows for a caller: at most max_rows, within timeout seconds. Refuses more (ROW_LIMIT) or longer (QUERY_TIMEOUT); a call with a limit reads
    one row more, to say whether the limit cut a tie."""
    order, limit = call.get("order_by", []), call.get("limit")
    found = answer(engine, {**call, "limit": limit + 1} if limit and order and not set(engine.package.withheld) else call)
    sc, group, late = engine.spark.sparkContext, f"fetch-{uuid.uuid4()}", threading.Event()
    timer = threading.Timer(timeout, lambda: (late.set(), sc.cancelJobGroup(group))) if timeout else None
    sc.setJobGroup(group, "fetch", interruptOnCancel=True)
    if timer:
        timer.start()
    try:
        rows = found.rows.limit(max_rows + 2).collect()
    except Exception:
        if late.is_set():
            raise SemanticError("QUERY_TIMEOUT", f"not ended in {timeout} s") from None
        raise
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if limit and len(rows) > limit:
        by = [o if isinstance(o, str) else o["id"] for o in order]
        if by and all(rows[limit][o] == rows[limit - 1][o] for o in by):
            found.notes.append({"code": "TIES_AT_LIMIT", "limit": limit})
        rows = rows[:limit]
    if len(rows) > max_rows:
        raise SemanticError("ROW_LIMIT", f"more than {max_rows} rows; group or filter further")
    if not rows and found.window:
        found.notes.append({"code": "EMPTY_RESULT_WINDOW", **found.window})
    return rows, found.notes
