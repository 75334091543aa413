"""Calls to DataFrames: leaves, their combination, dense series, zero or unknown, expressions, totals, order and limit.

Each measure is aggregated before anything is combined, so no join multiplies a value. Leaves of one entity and filter share one scan and
one aggregation. Leaves are combined by union and one more grouping, which matches unknown keys; a dense series crosses the groups with the
periods of a window, whose number is fixed by the window. Windows over a series count periods of that dense series.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SemanticError
from ..functions.scalars import call as scalar_call
from ..functions.infix import parse as infix
from ..functions.scalars import date_add, divide
from ..functions.words import check_strings, condition
from . import clock as clocks
from .governance import check_constraints, check_names, ids_of
from .leaf import Reader, Relation, held_by, snapshot, statistic
from .model import Measure, Package, Rollup
from .routes import child_route, lookups

READS = ("scoped_aggregate", "aggregate", "semi_additive")
KEYS = {"select", "group_by", "where", "having", "time", "order_by", "limit", "routes", "totals", "observation_scope"}
WINDOWED = {"rolling", "prior_period", "cumulative", "period_to_date"}
ZEROED = {"sum", "count", "count_distinct"}


class Engine:
    def __init__(self, spark: SparkSession, package: Package, relation: Relation | Mapping[str, DataFrame]):
        self.spark, self.package = spark, package
        self.relation: Relation = relation if callable(relation) else relation.__getitem__
        self.notes: list[dict] = []

    # -- the call -----------------------------------------------------------------------------------------------------------------------

    def query(self, call: dict) -> DataFrame:
        check_strings(call)
        if "parts" in call:
            return self._joined(call)
        if unknown := set(call) - KEYS:
            raise SemanticError("INVALID_QUERY", f"unknown keys {sorted(unknown)}", allowed=sorted(KEYS))
        clocks.check(call.get("time") or {})
        if call.get("observation_scope", "dataset") not in ("dataset", "query"):
            raise SemanticError("INVALID_QUERY", f"no observation scope {call['observation_scope']}", allowed=["dataset", "query"])
        check_names(self.package, call.get("select", []))
        items = [self._item(x) for x in call.get("select", [])]
        aliases = [a for a, _ in items]
        if self.package.constraints:
            read = {i for _, e in items for i in ids_of(e)} | {x if isinstance(x, str) else x.get("id") for x in call.get("select", [])}
            while more := ({i for n in read & set(self.package.metrics) for i in ids_of(self._named(n))} | {i for n in read for i in self._sources(n)}) - read:
                read |= more
            check_constraints(self.package, call, read)
        if len(set(aliases + call.get("group_by", []))) < len(aliases) + len(call.get("group_by", [])):
            raise SemanticError("DUPLICATE_OUTPUT_ALIAS", "two columns have one name")
        if secret := self._secret(call, items):
            return self.__class__(self.spark, replace(self.package, withheld={}), self.relation).query(call).drop(*secret)
        if not items:
            return self._ordered(self._listing(call), call, [])
        call = self._keyed(call)
        shown = {*aliases, *call.get("group_by", []), "period"}
        extra = list(dict.fromkeys(c["id"] for c in call.get("having", []) if c["id"] not in shown))
        items += [(n, self._named(n)) for n in extra]  # read for having, not shown
        df = self._level(call, items)
        for k in range(len(call.get("group_by", [])) - 1, -1, -1) if call.get("totals") else ():
            dropped = call["group_by"][k:]
            if not set(dropped) <= set(call["totals"]):
                continue
            part = self._level({**call, "group_by": call["group_by"][:k], "totals": None}, items)  # recomputed, never added up
            df = df.unionByName(part.withColumn("total_over", F.lit(",".join(dropped))), allowMissingColumns=True)
        for c in call.get("having", []):
            df = df.where(condition(F.col(f"`{c['id']}`"), c.get("word", "is"), c["value"]))
        return self._ordered(df.drop(*extra), call, aliases)

    def _keyed(self, call: dict) -> dict:
        """Names with a key are grouped by the key too, so that namesakes stay apart."""
        key = {g: k for g in call.get("group_by", []) if (k := getattr(self.package.dimensions.get(g), "key", None)) and k not in call["group_by"]}
        if not key:
            return call
        wider = lambda ids: list(dict.fromkeys(x for g in ids for x in ((g, key[g]) if g in key else (g,))))
        return {**call, "group_by": wider(call["group_by"]), **({"totals": wider(call["totals"])} if call.get("totals") else {})}

    def _secret(self, call: dict, items: list[tuple[str, dict]]) -> list[str]:
        """Columns whose values are withheld. They may only rank, and only so many groups as the package allows."""
        found: dict[str, set] = {}
        for (alias, e), x in zip(items, call.get("select", []), strict=True):
            names = {x if isinstance(x, str) else x.get("id")}
            for n in _walk(e, self):
                names |= {n.get("id"), *(n[k].get("id") for k in ("base", "converted") if k in n)}
            names |= {i for n in list(names) for i in self._sources(n)}
            if held := names & set(self.package.withheld):
                found[alias] = held
        if not found:
            return []
        order = [o if isinstance(o, str) else o["id"] for o in call.get("order_by", [])]
        most = min(self.package.withheld[n] for held in found.values() for n in held)
        if order[:1] != list(found) or not 0 < (call.get("limit") or 0) <= most or call.get("totals") or any(c["id"] in found for c in call.get("having", [])):
            raise SemanticError("POLICY_DENIED", f"{list(found)} may only rank up to {most} groups")
        return list(found)

    def _item(self, x: str | dict) -> tuple[str, dict]:
        if isinstance(x, str):
            return x, self._named(x)
        return x.get("as") or x["id"], {**self._named(x["id"]), **{k: v for k, v in x.items() if k not in ("id", "as")}} if "id" in x else x["expr"]

    def _sources(self, name: str | None) -> list[str]:
        """The measures that a lookup measure comes down to."""
        m = self.package.measures.get(name or "")
        return [m.lookup[1], *self._sources(m.lookup[1])] if m and m.lookup else []

    def _open(self, name: str) -> None:
        if closed := {name, *self._sources(name)} & self.package.denied:
            raise SemanticError("POLICY_DENIED", f"{name} isn't open", reads=sorted(closed))

    def _named(self, name: str) -> dict:
        self._open(name)
        if name in self.package.measures:
            return {"kind": "measure", "id": name}
        if name in self.package.metrics:
            e = self.package.metrics[name]
            return infix(e, self._named) if isinstance(e, str) else e
        raise SemanticError("OBJECT_NOT_FOUND", f"no measure or metric {name}")

    def _ordered(self, df: DataFrame, call: dict, aliases: list[str]) -> DataFrame:
        order = [(o, False) if isinstance(o, str) else (o["id"], o.get("desc", False)) for o in call.get("order_by", [])]
        if bad := [o for o, _ in order if o not in df.columns]:
            raise SemanticError("INVALID_ORDER_BY", f"{bad} isn't a column of the result")
        if not order and not call.get("limit"):
            return df.orderBy("period", *[F.col(f"`{g}`") for g in call.get("group_by", []) if g in df.columns]) if "period" in df.columns else df
        rest = [(g, False) for g in (*call.get("group_by", []), "period") if g in df.columns and g not in dict(order)]
        by = [F.col(f"`{o}`").desc_nulls_last() if desc else F.col(f"`{o}`").asc_nulls_last() for o, desc in order + rest]
        df = df.orderBy(*by)
        return df.limit(call["limit"]) if call.get("limit") else df

    def _listing(self, call: dict) -> DataFrame:
        """No select: the distinct values of the groups, from the entity that can look all of them up."""
        groups = call.get("group_by", [])
        wanted = [self.package.dimensions[g].entity for g in groups if g in self.package.dimensions]
        if not groups or len(wanted) < len(groups):
            raise SemanticError("INVALID_QUERY" if not groups else "OBJECT_NOT_FOUND", "nothing to select or list")
        for root in dict.fromkeys(wanted):
            try:
                reader = Reader(self.package, self.relation, root, call.get("routes"))
                cols = [reader.dimension(g).alias(g) for g in groups]
                reader.where(call.get("where", []))
                return reader.df.select(*cols).distinct()
            except SemanticError as e:
                if e.code != "PATH_NOT_FOUND":
                    raise
        raise SemanticError("PATH_NOT_FOUND", "no entity of the list can look up the others")

    def values(self, dimension: str, contains: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of a dimension's known values in order; `contains` is read as the filter word is."""
        reader = Reader(self.package, self.relation, self.package.dimensions[dimension].entity if dimension in self.package.dimensions else next(iter(self.package.entities)))
        value = reader.dimension(dimension)
        df = reader.df.select(value.alias("value")).where("value is not null")
        if contains is not None:
            df = df.where(condition(F.col("value"), "contains", contains))
        return df.distinct().orderBy("value").offset(offset).limit(limit)

    # -- one level of groups ------------------------------------------------------------------------------------------------------------

    def _level(self, call: dict, items: list[tuple[str, dict]]) -> DataFrame:
        time, groups = call.get("time") or {}, call.get("group_by", [])
        grain = time.get("grain")
        if grain and grain not in clocks.GRAINS:
            raise SemanticError("INVALID_TEMPORAL_BINDING", f"no grain {grain}")
        kinds = {n["kind"] for _, e in items for n in _walk(e, self)}
        if kinds & WINDOWED and not grain:
            raise SemanticError("WINDOW_TOTAL_UNSUPPORTED", "a look-back needs a grain")
        if kinds & WINDOWED and (time.get("start") or "last" in time or "this" in time):
            raise SemanticError("WINDOWED_TIME_FILTER_UNSUPPORTED", "a window's start would cut the look-back; filter the result by having")
        if kinds & WINDOWED and (cut := sorted(c["id"] for c in call.get("where", []) if "id" in c and self._temporal(c["id"]))):
            raise SemanticError("WINDOWED_TIME_FILTER_UNSUPPORTED", f"a filter on {cut} would cut the look-back; filter the result by having")
        reads: dict[str, dict] = {}
        exprs = [(alias, self._lift(e, reads)) for alias, e in items]
        if time and not time.get("clock"):
            used = {r.get("clock") or m.clock for r in reads.values() for m in [self.package.measures.get(r.get("id") or r.get("input", {}).get("id", ""))] if m and (r.get("clock") or m.clock)}
            if len(used) > 1:
                raise SemanticError("MIXED_TIME_ROLES", "state a clock: the measures are dated by different ones", options=sorted(used))
        keys = [*groups, *(["period"] if grain else [])]
        df = self._combine([self._leaf(n, r, call) for n, r in self._folded(reads)], keys)
        start, end, named = clocks.window(time) if time else (None, None, False)
        if grain and (named or kinds & WINDOWED or time.get("fill")):
            df = self._dense(df, groups, grain, start, end)
        df = self._settle(df, reads, call, grain)
        ctx = {"groups": groups, "grain": grain, "call": call}
        for n, r in reads.items():
            if r["kind"] == "total":
                df = self._with_total(df, n, r, keys, call)
        out = df.select(*[F.col(f"`{k}`") for k in keys], *[self._value(e, ctx).alias(a) for a, e in exprs])
        return out

    def _temporal(self, dimension: str) -> bool:
        """Whether a dimension reads a column that dates rows."""
        d = self.package.dimensions.get(dimension)
        return d is not None and any(c.entity == d.entity and re.search(rf"\b{re.escape(c.column)}\b", d.expr) for c in self.package.clocks.values())

    def _lift(self, e: dict, reads: dict) -> dict:
        """Replaces what is read from data by the column that will hold it."""
        kind = e["kind"]
        if kind in ("measure", "aggregate_if", "distribution", "conversion", "total"):
            key = json.dumps(e, sort_keys=True)
            name = next((n for n, r in reads.items() if r["key"] == key), None) or f"__m{len(reads)}"
            reads[name] = {**e, "key": key}
            return {"kind": "column", "name": name}
        if kind == "semi_additive" and self._measure(e["id"]).stock is None:
            raise SemanticError("INVALID_EXPRESSION_AST", f"{e['id']} isn't a stock")
        if kind in READS:  # a measure with its own conditions, also on entities, or statistic
            return self._lift({**e, "kind": "measure"}, reads)
        if kind == "metric":
            return self._lift(self._named(e["id"]), reads)
        if kind in ("ratio", "share", *WINDOWED) or "args" in e:
            parts = {k: self._lift(e[k], reads) for k in ("numerator", "denominator", "input") if k in e}
            if "args" in e:
                parts["args"] = [self._lift(a, reads) if isinstance(a, dict) else a for a in e["args"]]
            if kind in ("rolling", "cumulative", "period_to_date") and e["input"]["kind"] in ("ratio",):
                inner = e["input"]  # a window of a ratio is the ratio of its parts' windows
                return {"kind": "ratio", **{k: self._lift({**e, "input": inner[k]}, reads) for k in ("numerator", "denominator")}}
            if kind in ("rolling", "cumulative", "period_to_date", "share") and not self._summable(e["input"]):
                raise SemanticError("ROLLUP_UNSAFE", f"{kind} adds up what can't be added")
            return {**e, **parts}
        if kind == "literal":
            return e
        raise SemanticError("INVALID_EXPRESSION_AST", f"no expression kind {kind}")

    def _summable(self, e: dict) -> bool:
        if e["kind"] == "metric":
            return self._summable(self._named(e["id"]))
        if e["kind"] in ("add", "subtract"):
            return all(self._summable(a) for a in e["args"])
        if e["kind"] == "aggregate_if":
            return e["agg"] in ("sum", "count")
        m = self.package.measures.get(e.get("id", ""))
        return e["kind"] in ("measure", *READS) and m is not None and m.additive and not m.stock and e.get("agg", m.agg) in ("sum", "count")

    def _folded(self, reads: dict) -> list[tuple[list[str], list[dict]]]:
        """Plain reads of one entity, clock and filter share a scan; others stand alone."""
        shared: dict[tuple, tuple[list[str], list[dict]]] = {}
        for n, r in reads.items():
            if r["kind"] == "total":
                continue
            m = self.package.measures.get(r.get("id", ""))
            plain = r["kind"] in ("measure", "aggregate_if") and m is not None and not m.stock
            key = (m.entity, r.get("clock", m.clock), json.dumps(r.get("where", []))) if plain else (n,)
            names, specs = shared.setdefault(key, ([], []))
            names.append(n)
            specs.append(r)
        return list(shared.values())

    def _leaf(self, names: list[str], specs: list[dict], call: dict) -> DataFrame:
        r, groups, time = specs[0], call.get("group_by", []), call.get("time") or {}
        if r["kind"] == "conversion":
            from ..operators.conversion import conversion

            return conversion(self, names[0], r, call)
        m = self._measure(r.get("id") or r["input"]["id"])
        source = r["input"] if r["kind"] == "distribution" else r
        if found := self._rollup(specs, call):
            return self._rolled(found, names, specs, call)
        if r["kind"] != "distribution" and (crossed := self._crossed(names, specs, m, call)) is not None:
            return crossed
        clock_name = time.get("clock") or source.get("clock") or m.clock
        at = None
        reader = Reader(self.package, self.relation, m.entity, call.get("routes"))
        capped = self.package.edge_of(m.entity) != "data"
        if clock_name and (time or m.stock or capped or any(x.get("agg", m.agg) in ("first_value", "last_value") for x in specs) or any(h.valid for h in self.package.relationships)):
            if clock_name not in self.package.clocks:
                raise SemanticError("INVALID_TEMPORAL_ROLE", f"no clock {clock_name}")
            c = self.package.clocks[clock_name]
            t = reader.clock(c)  # may join first
            reader.df = reader.df.withColumn("__at", t)
            at = "__at"
            reader.at = at if time else None  # a history is entered at the query's time only
        elif time:
            raise SemanticError("MIXED_TIME_ROLES", f"{r.get('id')} has no clock")
        if at and time.get("grain"):
            reader.period = time["grain"], F.date_trunc(time["grain"], F.col(at)).cast("date")
        if at and capped:
            reader.df = self._capped(reader.df, F.col(at), m.entity, call)
        asked = [*call.get("where", []), *source.get("where", [])]
        dated = [c for c in asked if "id" in c and self._temporal(c["id"])] if m.stock is not None else asked
        reader.where(dated)
        start, end, _ = clocks.window(time) if time else (None, None, False)
        if start:
            reader.df = reader.df.where(F.col(at) >= F.lit(start.isoformat()).cast("timestamp_ntz"))
        if end:
            reader.df = reader.df.where(F.col(at) < F.lit(end.isoformat()).cast("timestamp_ntz"))
        bucket = F.date_trunc(time["grain"], F.col(at)).cast("date") if time.get("grain") else None
        if m.stock is not None:  # the snapshot is chosen on the clock alone; other filters read what it holds
            reader.df = snapshot(reader.df, m, m.entity, F.col(at), bucket, r.get("agg", m.agg) != "first_value")
            reader.where([c for c in asked if c not in dated])
        cols, fan = self._group_columns(reader, groups, m)
        keys = [c.alias(g) for g, c in cols.items()] + ([bucket.alias("period")] if bucket is not None else [])
        if r["kind"] == "distribution":
            return self._distribution(reader, names[0], r, m, keys)
        if fan:
            measures = [m if x is r else self._measure(x["id"]) for x in specs]
            return self._deduplicated(reader, names, specs, measures, keys)
        got = [c for n, x in zip(names, specs, strict=True) for c in self._statistics(reader, n, x, m if x is r else self._measure(x["id"]), at)]
        return reader.df.groupBy(*keys).agg(*got)

    def _edge(self, entity: str, call: dict) -> DataFrame:
        """One row: the instant up to which the entity's table is loaded (__edge), as declared."""
        declared, now = self.package.edge_of(entity), (call.get("time") or {}).get("now")
        stop = F.lit(now).cast("timestamp_ntz")
        if declared == "now":
            if now is None:
                raise SemanticError("INVALID_QUERY", "a table loaded up to now needs now")
            return self.spark.range(1).select((stop + F.expr("interval 1 microsecond")).alias("__edge"))
        _, table, column = declared
        log = self.relation(table)
        through = F.max(column)
        if dict(log.dtypes)[column] == "date":  # complete through the end of that day
            through = F.date_add(through, 1)
        through = through.cast("timestamp_ntz")
        return log.agg((F.least(through, stop) if now else through).alias("__edge"))

    def _capped(self, df: DataFrame, at: Column, entity: str, call: dict) -> DataFrame:
        return df.crossJoin(F.broadcast(self._edge(entity, call))).where(at < F.col("__edge")).drop("__edge")  # one row

    def _rollup(self, specs: list[dict], call: dict) -> Rollup | None:
        """A rollup that holds all that a leaf reads: its measures as they are, its dimensions, and whole periods of its clock."""
        if any(e.row_filter for e in self.package.entities.values()) or call.get("routes"):
            return None
        time = call.get("time") or {}
        start, end, _ = clocks.window(time) if time else (None, None, False)
        for held in self.package.rollups:
            ids = [*call.get("group_by", []), *(c.get("id", "") for x in (call, *specs) for c in x.get("where", []))]
            if not set(ids) <= set(held.dimensions) or set(ids) & self.package.denied:
                continue
            if any(x["kind"] != "measure" or x["id"] not in held.measures for x in specs):
                continue
            measures = [self.package.measures[x["id"]] for x in specs]
            if any(self.package.edge_of(m.entity) != "data" for m in measures):
                continue
            if any(x.get("agg", m.agg) != m.agg or m.agg not in ("sum", "count") or not m.additive or m.stock is not None or m.lookup for x, m in zip(specs, measures, strict=True)):
                continue
            clocked = {time.get("clock") or x.get("clock") or m.clock for x, m in zip(specs, measures, strict=True)} == {held.clock}
            whole = held.grain and all(clocks.whole(d, held.grain) for d in (start, end))
            if not time or clocked and whole and time.get("grain", held.grain) in clocks.COARSER[held.grain]:
                return held
        return None

    def _rolled(self, held: Rollup, names: list[str], specs: list[dict], call: dict) -> DataFrame:
        df, time = self.relation(held.table), call.get("time") or {}
        for c in (*call.get("where", []), *specs[0].get("where", [])):
            df = df.where(condition(F.col(held.dimensions[c["id"]]), c.get("word", "is"), c["value"]))
        start, end, _ = clocks.window(time) if time else (None, None, False)
        if start:
            df = df.where(F.col(held.period) >= F.lit(start.isoformat()).cast("date"))
        if end:
            df = df.where(F.col(held.period) < F.lit(end.isoformat()).cast("date"))
        keys = [F.col(held.dimensions[g]).alias(g) for g in call.get("group_by", [])]
        if time.get("grain"):
            keys.append(F.date_trunc(time["grain"], F.col(held.period)).cast("date").alias("period"))
        return df.groupBy(*keys).agg(*[c for n, x in zip(names, specs, strict=True) for c in (F.sum(held.measures[x["id"]]).alias(n), F.count(F.lit(1)).alias(f"{n}n"))])

    def _statistics(self, reader: Reader, name: str, x: dict, m: Measure, at: str | None) -> list[Column]:
        value, counted = reader.value(m), F.lit(1)
        agg = x.get("agg", m.agg)
        if agg not in m.allowed:
            raise SemanticError("UNSUPPORTED_AGGREGATION", f"{agg} isn't allowed on {x['id']}", allowed=m.allowed)
        if x["kind"] == "aggregate_if":
            agg = x["agg"]
            tests = [condition(reader.dimension(c["id"]), c.get("word", "is"), c["value"]) for c in x["if"]]
            value, counted = F.when(reduce(Column.__and__, tests), value), F.when(reduce(Column.__and__, tests), F.lit(1))
        if m.stock is not None:
            agg = "sum" if agg in ("first_value", "last_value") else agg
        if (not m.additive or m.lookup) and agg == "sum":
            raise SemanticError("ROLLUP_UNSAFE", f"{x['id']} can't be summed")
        got = statistic(agg, value, F.col(at) if at else None, x.get("p"))
        return [got.alias(name), F.count(counted).alias(f"{name}n")]  # rows, so that a sum of unknown amounts only stays unknown

    def _group_columns(self, reader: Reader, groups: list[str], m: Measure) -> tuple[dict[str, Column], bool]:
        """Lookups where possible; a group on a child entity makes the leaf fan out, which only keyed rows allow."""
        cols: dict[str, Column] = {}
        below: dict[tuple, list[str]] = {}  # groups of one child are the values that one of its rows holds together
        for g in groups:
            try:
                cols[g] = reader.dimension(g)
            except SemanticError as e:
                if e.code != "PATH_NOT_FOUND":
                    raise
                below.setdefault(self._child(m.entity, self.package.dimensions[g].entity, reader.routes), []).append(g)
        for hops, held in below.items():
            if not self.package.entities[m.entity].key or m.stock is not None:
                raise SemanticError("MIXED_GRAIN_INVALID", f"{held} would multiply rows of {m.entity}")
            child = Reader(self.package, self.relation, hops[0].source, reader.routes)
            values = [child.dimension(g).alias(f"__{g}") for g in held]
            for hop in hops[:-1]:
                child.reach(hop.target)
            by = [f"__c{i}" for i in range(len(hops[-1].on))]
            pairs = child.df.select(*[F.col(f"{hops[-1].source}${a}").alias(c) for c, (a, _) in zip(by, hops[-1].on, strict=True)], *values)
            pairs = held_by(pairs, by, [self.relation(self.package.entities[e].table) for e in (hops[0].source, m.entity)])
            reader.df = reader.df.join(pairs, [F.col(f"{m.entity}${b}") == F.col(c) for c, (_, b) in zip(by, hops[-1].on, strict=True)]).drop(*by)
            cols |= {g: F.col(f"`__{g}`") for g in held}
            self._note("REWRITE_APPLIED", rewrite="fanout_dedup", overlapping_groups=held, path=[h.target for h in hops])
        return {g: cols[g] for g in groups}, bool(below)

    def _crossed(self, names: list[str], specs: list[dict], m: Measure, call: dict) -> DataFrame | None:
        """Groups that neither lookups nor the measure's own children reach: a parent's value on its children's rows, or the values of the
        children of a row that can be looked up. None where the plain way reads them, or nothing does."""
        groups = call.get("group_by", [])
        known = [g for g in groups if g in self.package.dimensions and g not in self.package.denied]
        far = [g for g in known if self.package.dimensions[g].entity != m.entity and not lookups(self.package, m.entity, self.package.dimensions[g].entity)]
        if not far or len(known) < len(groups):
            return None
        try:
            for g in far:
                self._child(m.entity, self.package.dimensions[g].entity, call.get("routes"))
            return None
        except SemanticError as e:
            if e.code != "PATH_NOT_FOUND":
                raise
        measures = [self._measure(x["id"]) for x in specs]
        aggs = [x.get("agg", y.agg) for x, y in zip(specs, measures, strict=True)]
        asked = {self.package.dimensions[g].entity for g in known} | {self.package.dimensions[c["id"]].entity for c in call.get("where", []) if c.get("id") in self.package.dimensions}
        rows = next((e for e in (self.package.dimensions[g].entity for g in known) if e != m.entity and all(x == e or lookups(self.package, e, x) for x in {*asked, m.entity})), None)
        child = {self.package.dimensions[g].entity for g in far}
        asked_via = (call.get("routes") or {}).get(f"{m.entity}->{next(iter(child))}")
        hops = [r for r in self.package.relationships if {r.source} == child and not r.valid and not r.forward and lookups(self.package, m.entity, r.target) and (not asked_via or asked_via[-2:-1] == [r.target])]
        if rows is None and not hops:
            return None
        plain = all(x["kind"] == "measure" and not x.get("where") for x in specs) and not call.get("time") and not call.get("having") and not any("id" not in c for c in call.get("where", []))
        if not plain or not set(aggs) <= {"sum", "count", "avg", "count_distinct"} or any(not y.additive or y.stock is not None or y.lookup for y in measures):
            raise SemanticError("MIXED_GRAIN_INVALID", f"{far} would multiply rows of {m.entity}")
        got = lambda reader, v: [c for n, agg in zip(names, aggs, strict=True) for c in (statistic(agg, v(n)).alias(n), F.count(F.lit(1)).alias(f"{n}n"))]
        if rows is not None:
            if not (key := self.package.entities[m.entity].key):
                raise SemanticError("ROW_GRAIN_UNSUPPORTED", f"{m.entity} has no key")
            reader = Reader(self.package, self.relation, rows, call.get("routes"))
            cols = [reader.dimension(g).alias(g) for g in groups]
            reader.where(call.get("where", []))
            reader.reach(m.entity)
            own = [F.col(f"{m.entity}${k}") for k in key]
            there = reduce(Column.__and__, [k.isNotNull() for k in own])
            once = reader.df.select(*cols, *[k.alias(f"__key{i}") for i, k in enumerate(own)], *[F.when(there, reader.value(y)).alias(f"__v{n}") for n, y in zip(names, measures, strict=True)]).distinct()
            self._note("REWRITE_APPLIED", rewrite="parent_value", rows_entity=rows)
            named = F.count("__key0") > 0  # a group that names no parent is unknown, not 0
            return once.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(*[c for n, agg in zip(names, aggs, strict=True) for c in (F.when(named, statistic(agg, F.col(f"__v{n}"))).alias(n), F.count(F.lit(1)).alias(f"{n}n"))])
        if len(hops) > 1:
            raise SemanticError("AMBIGUOUS_PATH", f"{len(hops)} routes lead from {m.entity} to {child}", options=[[r.target, r.source] for r in hops])
        hop = hops[0]
        reader = Reader(self.package, self.relation, m.entity, call.get("routes"))
        reader.reach(hop.target)
        cols = {g: reader.dimension(g) for g in groups if g not in far}
        reader.where(call.get("where", []))
        below = Reader(self.package, self.relation, hop.source, call.get("routes"))
        sets = below.df.select(*[F.col(f"{hop.source}${a}").alias(f"__c{i}") for i, (a, _) in enumerate(hop.on)], *[below.dimension(g).alias(f"__{g}") for g in far])
        sets = held_by(sets, [f"__c{i}" for i in range(len(hop.on))], [self.relation(self.package.entities[e].table) for e in (hop.source, m.entity)])
        reader.df = reader.df.join(sets, [F.col(f"{hop.target}${b}") == F.col(f"__c{i}") for i, (_, b) in enumerate(hop.on)], "left")
        self._note("REWRITE_APPLIED", rewrite="child_values", overlapping_groups=far, path=[hop.target, hop.source])
        values = {n: reader.value(y) for n, y in zip(names, measures, strict=True)}
        return reader.df.groupBy(*[cols.get(g, F.col(f"`__{g}`")).alias(g) for g in groups]).agg(*got(reader, values.__getitem__))

    def _note(self, code: str, **details) -> None:
        """What an answer says beside its rows."""
        note = {"code": code, **details}
        if note not in self.notes:
            self.notes.append(note)

    def _child(self, parent: str, goal: str, asked: dict | None) -> tuple:
        """The hops from rows that look up both to the parent: the goal itself, or one child of the parent that can look the goal up."""
        try:
            return child_route(self.package, parent, goal, asked)
        except SemanticError as e:
            if e.code != "PATH_NOT_FOUND":
                raise
        found = [r for r in self.package.relationships if r.target == parent and not r.forward and lookups(self.package, r.source, goal)]
        if len(found) != 1:
            raise SemanticError("AMBIGUOUS_PATH" if found else "PATH_NOT_FOUND", f"{len(found)} children of {parent} lead to {goal}", options=[r.source for r in found])
        return (found[0],)

    def _deduplicated(self, reader: Reader, names: list[str], specs: list[dict], measures: list[Measure], keys: list[Column]) -> DataFrame:
        """Each row counts once in every group that it has a child in."""
        m = measures[0]
        value = {n: reader.value(x) for n, x in zip(names, measures, strict=True)}
        aggs = [x.get("agg", y.agg) for x, y in zip(specs, measures, strict=True)]
        if any(x["kind"] != "measure" for x in specs) or not set(aggs) <= {"sum", "count", "avg", "count_distinct"}:
            raise SemanticError("REWRITE_NOT_SUPPORTED", "only sum, count, avg and count_distinct can be grouped by a child")
        own = [F.col(f"{m.entity}${k}").alias(f"__key{i}") for i, k in enumerate(self.package.entities[m.entity].key)]
        once = reader.df.select(*own, *keys, *[v.alias(f"__v{n}") for n, v in value.items()]).distinct()
        by = [c for c in once.columns if not c.startswith(("__key", "__v"))]
        return once.groupBy(*[F.col(f"`{c}`") for c in by]).agg(*[c for n, agg in zip(names, aggs, strict=True) for c in (statistic(agg, F.col(f"__v{n}")).alias(n), F.count(F.lit(1)).alias(f"{n}n"))])

    def _distribution(self, reader: Reader, name: str, r: dict, m: Measure, keys: list[Column]) -> DataFrame:
        """A statistic over one value per entity and group; rows without the entity don't count."""
        entity = r["entity"]
        reader.reach(entity)
        own = [F.col(f"{entity}${k}") for k in self.package.entities[entity].key]
        per = reader.df.where(reduce(Column.__and__, [k.isNotNull() for k in own])).groupBy(*[k.alias(f"__e{i}") for i, k in enumerate(own)], *keys)
        per = per.agg(statistic(r["input"].get("agg", m.agg), reader.column(m.entity, m.expr)).alias("__v"))
        by = [c for c in per.columns if not c.startswith("__")]
        return per.groupBy(*[F.col(f"`{c}`") for c in by]).agg(statistic(r["agg"], F.col("__v"), p=r.get("p")).alias(name), F.count("__v").alias(f"{name}n"))

    def _measure(self, name: str) -> Measure:
        self._open(name)
        if name not in self.package.measures:
            raise SemanticError("OBJECT_NOT_FOUND", f"no measure {name}")
        return self.package.measures[name]

    def _combine(self, leaves: list[DataFrame], keys: list[str]) -> DataFrame:
        if len(leaves) == 1:
            return leaves[0]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), leaves)
        values = [c for c in whole.columns if c not in keys]
        return whole.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[F.first(F.col(f"`{v}`"), ignorenulls=True).alias(v) for v in values])

    def _dense(self, df: DataFrame, groups: list[str], grain: str, start, end) -> DataFrame:
        """Every period of the window, or between the first and last seen, for every group."""
        step = F.expr({"week": "interval 7 days", "quarter": "interval 3 months"}.get(grain, f"interval 1 {grain}"))
        seen = df.agg(F.min("period").alias("a"), F.max("period").alias("b"))
        first = F.date_trunc(grain, F.lit(start.isoformat())).cast("date") if start else F.col("a")
        last = F.date_trunc(grain, F.lit(end.isoformat()).cast("timestamp_ntz") - F.expr("interval 1 microsecond")).cast("date") if end else F.col("b")
        spine = seen.where(first.isNotNull() & last.isNotNull()).select(F.explode(F.sequence(first, last, step)).alias("period"))
        frame = df.select(*[F.col(f"`{g}`") for g in groups]).distinct().crossJoin(F.broadcast(spine)) if groups else spine
        frame = frame.select(*[F.col(f"`{g}`").alias(f"__{g}") for g in groups], F.col("period").alias("__period"))
        on = [F.col(f"`__{k}`").eqNullSafe(F.col(f"`{k}`")) for k in (*groups, "period")]
        joined = frame.join(df, on, "left")
        values = [c for c in df.columns if c not in groups and c != "period"]
        return joined.select(*[F.col(f"`__{k}`").alias(k) for k in (*groups, "period")], *[F.col(f"`{v}`") for v in values])

    def _settle(self, df: DataFrame, reads: dict, call: dict, grain: str | None) -> DataFrame:
        """A sum or count of no rows is 0 where the measure has data at all, and, by period, between its first and last period."""
        marks = []
        for n, r in reads.items():
            if r["kind"] not in ("measure", "aggregate_if"):
                continue
            m = self._measure(r["id"])
            agg = r.get("agg", m.agg)
            if agg not in ZEROED or not m.additive or m.stock is not None or m.lookup:
                continue
            if held := self._rollup([r], call):
                whole = self.relation(held.table)
                t = F.date_trunc(grain, F.col(held.period)).cast("date") if grain else None
                marks.append((n, whole.agg(F.count(held.measures[r["id"]]).alias(f"{n}seen"), *([F.min(t).alias(f"{n}lo"), F.max(t).alias(f"{n}hi")] if grain else []))))
                continue
            reader = Reader(self.package, self.relation, m.entity, call.get("routes"))
            if call.get("observation_scope") == "query":  # data is what the call's own filters leave; else the whole table
                reader.where([c for c in call.get("where", []) if "over" not in c])
            value = reader.column(m.entity, m.expr)
            ends = [F.count(value).alias(f"{n}seen")]
            clock_name, now = (call.get("time") or {}).get("clock") or r.get("clock") or m.clock, (call.get("time") or {}).get("now")
            capped = self.package.edge_of(m.entity) != "data"
            at = reader.clock(self.package.clocks[clock_name]) if clock_name and (grain or capped) else None
            if at is not None and capped:
                reader.df = self._capped(reader.df, at, m.entity, call)
            if grain:
                t = F.date_trunc(grain, at).cast("date")
                past = F.when(at <= F.lit(now).cast("timestamp_ntz"), t) if now else t
                ends += [F.min(t).alias(f"{n}lo"), F.max(past).alias(f"{n}hi")]
            one = reader.df.agg(*ends)
            if grain and capped:  # periods that end by the edge; one that a load of this morning cuts counts too
                step = {"week": "interval 7 days", "quarter": "interval 3 months"}.get(grain, f"interval 1 {grain}")
                today = F.date_trunc("day", F.lit(now).cast("timestamp_ntz")) if now else F.lit(None).cast("timestamp_ntz")
                reached = F.col("__edge") - F.expr("interval 1 microsecond")
                whole = F.date_trunc(grain, F.col("__edge")) - F.expr(step)
                last = F.when(F.coalesce(F.col("__edge") >= today, F.lit(False)), F.date_trunc(grain, reached)).otherwise(whole).cast("date")
                one = one.crossJoin(F.broadcast(self._edge(m.entity, call))).withColumn(f"{n}hi", last).drop("__edge")  # one row
            marks.append((n, one))
        for n, one in marks:
            df = df.crossJoin(F.broadcast(one))  # one row
            inside = (F.col(f"{n}seen") > 0) & (F.col("period").between(F.col(f"{n}lo"), F.col(f"{n}hi")) if grain else F.lit(True))
            df = df.withColumn(n, F.when(F.col(n).isNull() & (F.coalesce(F.col(f"{n}n"), F.lit(0)) == 0) & inside, F.lit(0)).otherwise(F.col(n))).drop(f"{n}seen", f"{n}lo", f"{n}hi")
        return df

    def _with_total(self, df: DataFrame, name: str, r: dict, keys: list[str], call: dict) -> DataFrame:
        """The same call without some groups, beside each row: computed anew, so also right for counts of distinct values."""
        over = r["over"]
        rest = [g for g in call.get("group_by", []) if g not in over]
        time = call.get("time") if "period" not in over else {k: v for k, v in (call.get("time") or {}).items() if k != "grain"}
        inner = self._level({**call, "group_by": rest, "time": time}, [(name, r["input"])])
        on = [*rest, *(["period"] if (time or {}).get("grain") else [])]
        inner = inner.select(*[F.col(f"`{k}`").alias(f"__t{i}") for i, k in enumerate(on)], name)
        if not on:
            return df.crossJoin(F.broadcast(inner))  # one row
        return df.join(inner, [F.col(f"`{k}`").eqNullSafe(F.col(f"__t{i}")) for i, k in enumerate(on)], "left").drop(*[f"__t{i}" for i in range(len(on))])

    # -- expressions over the combined leaves ---------------------------------------------------------------------------------------------

    def _value(self, e: dict, ctx: dict) -> Column:
        kind = e["kind"]
        if kind == "column":
            return F.col(e["name"])
        if kind == "literal":
            return F.lit(e["value"])
        part = lambda x: self._value(x, ctx) if isinstance(x, dict) else x
        if kind == "ratio":
            return divide(part(e["numerator"]), part(e["denominator"]))
        if kind in ("add", "subtract", "multiply", "divide"):
            ops = {"add": Column.__add__, "subtract": Column.__sub__, "multiply": Column.__mul__, "divide": divide}
            return reduce(ops[kind], [a if isinstance(a, Column) else F.lit(a) for a in map(part, e["args"])])
        if kind == "call":
            return scalar_call(e["name"], [part(a) for a in e["args"]])
        if kind == "case":
            test, yes, no = map(part, e["args"])
            return F.when(test, yes).otherwise(no)
        if kind == "comparison":
            return condition(part(e["args"][0]), e["word"], e["args"][1])
        if kind in ("in", "not_in"):
            return condition(part(e["args"][0]), "is" if kind == "in" else "not", e["args"][1])
        if kind == "between":
            x, low, high = map(part, e["args"])
            return (x >= low) & (x <= high)
        if kind == "boolean":
            tests = [part(a) for a in e["args"]]
            return ~tests[0] if e["op"] == "not" else reduce({"and": Column.__and__, "or": Column.__or__}[e["op"]], tests)
        if kind == "nullif":
            return F.nullif(*[a if isinstance(a, Column) else F.lit(a) for a in map(part, e["args"])])
        if kind == "date_add":
            return date_add(e["unit"], e["value"], part(e["args"][0]))
        if off := [g for g in e.get("partition_by", []) if g not in ctx["groups"]]:  # a window runs within each group of the call
            raise SemanticError("INVALID_QUERY", f"partition_by names {off}, which the call doesn't group by")
        groups = [F.col(f"`{g}`") for g in ctx["groups"]]
        value = part(e["input"])
        if kind == "share":
            rest = [F.col(f"`{g}`") for g in (*ctx["groups"], *(["period"] if ctx["grain"] else [])) if g not in e["over"]]
            return divide(value, F.sum(value).over(Window.partitionBy(*rest)))
        by = Window.partitionBy(*groups).orderBy("period")
        if kind == "prior_period":
            return F.lag(value, clocks.rows(ctx["grain"], e["unit"], e["value"])).over(by)
        if kind == "rolling":
            return F.sum(value).over(by.rowsBetween(1 - clocks.rows(ctx["grain"], e["unit"], e["value"]), 0))
        if kind == "cumulative":
            return F.sum(value).over(by.rowsBetween(Window.unboundedPreceding, 0))
        inside = Window.partitionBy(*groups, F.date_trunc(e["period"], F.col("period"))).orderBy("period")
        return F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))

    # -- joined calls ---------------------------------------------------------------------------------------------------------------------

    def _joined(self, call: dict) -> DataFrame:
        """Results of several calls side by side on equal, known keys; `keep` names the parts whose keys stay (all by default).

        Each part is settled over the known keys of all parts: where a part has no rows for a key, its sums and counts are what the part says of
        a group without rows. Rows with an unknown key meet none and stay on their own.
        """
        parts, join = call["parts"], call.get("join") or []
        if unknown := set(call) - {"parts", "join", "keep"}:
            raise SemanticError("INVALID_QUERY", f"unknown keys {sorted(unknown)} of a joined call", allowed=["join", "keep", "parts"])
        if len(parts) < 2 or len(join) != len(parts) or not join[0] or len({len(k) for k in join}) > 1:
            raise SemanticError("INVALID_QUERY", "a joined call needs two parts, and as many keys of each")
        keep = call.get("keep", "all")
        if keep != "all" and (not isinstance(keep, list) or not set(keep) <= set(range(len(parts)))):
            raise SemanticError("INVALID_QUERY", "keep names parts by their place")
        for keys, part in zip(join, parts, strict=True):
            if left := set(keys) - set(part.get("group_by", [])):
                raise SemanticError("INVALID_QUERY", f"{sorted(left)} isn't grouped by in its part")
        for j, pairs in enumerate(zip(*join, strict=True)):
            for other in pairs[1:]:
                if not self._same_key(pairs[0], other):
                    raise SemanticError("INVALID_QUERY", f"{pairs[0]} and {other} don't name the same thing", place=j)
        names = [f"key{j}" for j in range(len(join[0]))]
        frames = [self.query(p) for p in parts]
        keyed = [df.withColumnsRenamed(dict(zip(keys, names, strict=True))) for df, keys in zip(frames, join, strict=True)]
        known = reduce(Column.__and__, [F.col(n).isNotNull() for n in names])
        domain = reduce(DataFrame.unionByName, [df.where(known).select(*names) for df in keyed]).distinct()
        named, columns = [], []
        for i, (df, part, keys) in enumerate(zip(keyed, parts, join, strict=True)):
            values = [c for c in df.columns if c not in names]
            own = df.withColumn(f"in{i}", F.lit(True))
            if set(part.get("group_by", [])) == set(keys) and "period" not in values and not part.get("having") and not part.get("limit"):
                empty = self._empty_group(part)
                if empty is not None:
                    full = domain.join(own.where(known), names, "left").crossJoin(F.broadcast(empty))  # one row
                    settled = full.select(*names, *[F.when(F.col(f"in{i}").isNull(), F.col(f"__empty_{c}")).otherwise(F.col(f"`{c}`")).alias(c) if f"__empty_{c}" in full.columns else F.col(f"`{c}`") for c in values], f"in{i}")
                    own = settled.unionByName(own.where(~known))
            renamed = {c: f"p{i}.{c}" for c in values if c in columns}  # a name that an earlier part has
            columns += [renamed.get(c, c) for c in values]
            named.append(own.withColumnsRenamed(renamed))
        out = reduce(lambda a, b: a.join(b, names, "full_outer"), named)
        flags = {f"in{i}": F.coalesce(F.col(f"in{i}"), F.lit(False)) for i in range(len(parts))}
        if keep != "all":
            out = out.where(reduce(Column.__and__, [flags[f"in{i}"] for i in keep]))
        self._note("PARTS_JOINED", parts=len(parts), keys=[list(k) for k in join], keep=keep)
        return out.select(*[flags[c].alias(c) if c in flags else F.col(f"`{c}`") for c in out.columns])

    def _same_key(self, a: str, b: str) -> bool:
        """Whether two group columns may be joined: one dimension, or columns of one relationship or of the same key."""
        if a == b:
            return a != "period"
        x, y = self.package.dimensions.get(a), self.package.dimensions.get(b)
        if x is None or y is None:
            return False
        ends = lambda d: {(d.entity, d.expr)} | {(r.target, t) for r in self.package.relationships if r.source == d.entity for s, t in r.on if s == d.expr}
        return bool(ends(x) & ends(y))

    def _empty_group(self, part: dict) -> DataFrame | None:
        """One row: what the part's settled sums and counts read for a group without rows; none where it has no such column."""
        names = []
        for x in part.get("select", []):
            alias, e = self._item(x)
            m = self.package.measures.get(e.get("id", ""))
            if e["kind"] in ("measure", "aggregate_if") and m and m.additive and m.stock is None and not m.lookup and (e["agg"] if e["kind"] == "aggregate_if" else e.get("agg", m.agg)) in ZEROED:
                names.append(alias)
        if not names:
            return None
        inner = {k: v for k, v in part.items() if k not in ("group_by", "order_by", "limit", "totals")} | {"where": [*part.get("where", [])]}
        whole = self.query({**inner, "select": [x for x in part["select"] if self._item(x)[0] in names]})  # null only where nothing is known at all
        return whole.select(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(0)).alias(f"__empty_{n}") for n in names])


def _walk(e: dict, engine: Engine):
    yield e
    if e["kind"] == "metric":
        yield from _walk(engine._named(e["id"]), engine)
    for k in ("numerator", "denominator", "input"):
        if isinstance(e.get(k), dict):
            yield from _walk(e[k], engine)
    for a in e.get("args", []):
        if isinstance(a, dict):
            yield from _walk(a, engine)
