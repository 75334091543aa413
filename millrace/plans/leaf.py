"""Leaves: one aggregate of one entity's rows, with lookups, filters, fan-out rewrites and snapshots."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import SemanticError
from ..functions.words import condition
from .model import Clock, Measure, Package, Relationship
from .routes import child_route, lookups, route

Relation = Callable[[str], DataFrame]

#: So many bytes of a table are one task's share of its rows where they are dealt by key, up to a number of tasks.
SHARE, MOST_TASKS = 2 << 20, 20_000


def shares(table: DataFrame) -> int:
    """Tasks for a table's rows, by the size of what it is read from as the planner knows it (no job); the session's number, where it doesn't."""
    spark = table.sparkSession
    plan = spark.sql("EXPLAIN COST SELECT * FROM {table}", table=table).first()[0].split("== Physical Plan ==")[0]
    nodes = [(re.search("[A-Za-z]", x).start(), x.rpartition("sizeInBytes=")[2]) for x in plan.splitlines() if "sizeInBytes=" in x]
    leaves = [re.match(r"([\d.]+) (B|[KMGT]iB)\b", x) for (depth, x), (after, _) in zip(nodes, [*nodes[1:], (0, "")], strict=True) if after <= depth]
    if not leaves or None in leaves:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = sum(float(x[1]) * 1024 ** ("B", "KiB", "MiB", "GiB", "TiB").index(x[2]) for x in leaves)
    return min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, int(size // SHARE) + 1))


def held_by(rows: DataFrame, keys: list[str], tables: list[DataFrame]) -> DataFrame:
    """Distinct rows, dealt by keys to as many tasks as the larger of the tables that meet by them needs. Rows are made distinct where they
    are joined and not before they are dealt too, so a task holds its share of keys only, however large the tables are."""
    return rows.repartition(max(map(shares, tables)), *keys).distinct()


def statistic(agg: str, value: Column, clock: Column | None = None, p: float | None = None, key: list[Column] | None = None) -> Column:
    if agg == "count_distinct":
        return F.count_distinct(*(key or [value]))
    if agg in ("first_value", "last_value"):
        if clock is None:
            raise SemanticError("UNSUPPORTED_AGGREGATION", f"{agg} needs a clock")
        return _by_clock(agg, value, clock)
    if agg == "percentile":
        if p is None or not 0 <= p <= 1:
            raise SemanticError("UNSUPPORTED_AGGREGATION", "percentile needs p between 0 and 1")
        return F.percentile(value, F.lit(p))
    if agg == "single_value":
        return F.when(F.min(value) == F.max(value), F.max(value))
    if agg == "avg":  # of an exact sum, so the result doesn't depend on the order of rows
        return F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "median": F.median}[agg](value)


def _by_clock(agg: str, value: Column, clock: Column) -> Column:
    """The first or last known value; of one instant's, the least or greatest, whatever the order of rows."""
    at = F.when(value.isNotNull() & clock.isNotNull(), F.struct(clock.alias("t"), value.alias("v")))
    return (F.min if agg == "first_value" else F.max)(at).v


class Reader:
    """Rows of an entity with other entities' columns beside them; every entity is joined once, under its own prefix."""

    def __init__(self, package: Package, relation: Relation, start: str, routes: dict | None = None, at: str | None = None):
        self.package, self.relation, self.start, self.routes, self.at = package, relation, start, routes, at
        self.df = self._of(start)
        self.joined: dict[str, Relationship | None] = {start: None}
        self.period: tuple[str, Column] | None = None  # grain and bucket of the call's series, for thresholds by period

    def _of(self, entity: str) -> DataFrame:
        spec = self.package.entities[entity]
        df = self.relation(spec.table)
        if spec.row_filter:
            df = df.where(spec.row_filter)
        return df.select(*[F.col(c).alias(f"{entity}${c}") for c in df.columns])

    def column(self, entity: str, expr: str) -> Column:
        """A SQL expression on an entity's columns, joining the entity first."""
        self.reach(entity)
        return F.expr(_prefixed(expr, entity, self.relation(self.package.entities[entity].table).columns))

    def clock(self, c: Clock) -> Column:
        at = self.column(c.entity, c.column)
        return F.convert_timezone(F.lit(c.stored), F.lit(c.zone), at) if c.stored and c.zone else at

    def value(self, m: Measure) -> Column:
        """What a measure reads of a row; a lookup measure joins its parents' totals, one row per parent."""
        if m.lookup is None:
            return self.column(m.entity, m.expr)
        parent, name = m.lookup
        held = f"__{parent}.{name}"
        self.reach(parent)
        if held not in self.df.columns:
            key, source = self.package.entities[parent].key, self.package.measures[name]
            inner = Reader(self.package, self.relation, source.entity, self.routes)
            inner.reach(parent)
            total = statistic(source.agg, inner.value(source)).alias(held)
            per = inner.df.groupBy(*[F.col(f"{parent}${k}").alias(f"__p{i}") for i, k in enumerate(key)]).agg(total)
            self.df = self.df.join(per, [F.col(f"{parent}${k}") == F.col(f"__p{i}") for i, k in enumerate(key)], "left").drop(*[f"__p{i}" for i in range(len(key))])
        known = F.col(f"{parent}${self.package.entities[parent].key[0]}").isNotNull()
        found = F.col(f"`{held}`")
        return F.when(known, F.coalesce(found, F.lit(0))) if self.package.measures[name].agg in ("sum", "count", "count_distinct") else found

    def reach(self, entity: str) -> None:
        for hop in () if entity in self.joined else route(self.package, self.start, entity, self.routes):
            if hop.target in self.joined:
                if self.joined[hop.target] != hop:
                    raise SemanticError("PATH_JOIN_CONFLICT", f"{hop.target} is needed through two relationships")
                continue
            self.lookup(hop)

    def lookup(self, hop: Relationship) -> None:
        on = [F.col(f"{hop.source}${a}") == F.col(f"{hop.target}${b}") for a, b in hop.on]
        if hop.valid:
            if not self.at:
                raise SemanticError("FANOUT_UNSAFE", f"{hop.target} is a history: the query needs a time")
            t, (a, b) = F.col(self.at), hop.valid
            on += [F.col(f"{hop.target}${a}") <= t, F.col(f"{hop.target}${b}").isNull() | (F.col(f"{hop.target}${b}") > t)]
        self.df = self.df.join(self._of(hop.target), on, "left")
        self.joined[hop.target] = hop

    def dimension(self, name: str) -> Column:
        if name not in self.package.dimensions:
            raise SemanticError("OBJECT_NOT_FOUND", f"no dimension {name}")
        if name in self.package.denied:
            raise SemanticError("POLICY_DENIED", f"{name} isn't open")
        d = self.package.dimensions[name]
        value = self.column(d.entity, d.expr)
        return F.when(~value.isin(*d.unknown), value) if d.unknown else value

    def where(self, conditions: list[dict]) -> None:
        """Lookup conditions filter; those on child entities keep parents by semi or anti join. A single plain condition on a child asks
        for any child that meets it; of several, or a negated one, it isn't said whether one child must meet them."""
        child = {c["id"]: self._child_of(c["id"]) for c in conditions if "id" in c}
        plain = [c for c in conditions if child.get(c.get("id"))]
        if len(plain) > 1 or any(c.get("word", "is").startswith(("not", "missing")) for c in plain):
            raise SemanticError("AMBIGUOUS_CHILD_SCOPE", "state any or none for conditions on children", options=[{w: child[c["id"]], "where": [c]} for w in ("any", "none") for c in plain])
        for c in conditions:
            if "any" in c or "none" in c or "having" in c:
                self.entity_filter(c)
            elif child[c["id"]]:
                self.entity_filter({"any": child[c["id"]], "where": [c]})
            else:
                test = condition(self.dimension(c["id"]), c.get("word", "is"), c["value"])  # may join first
                self.df = self.df.where(test)

    def _child_of(self, dimension: str) -> str | None:
        """The child entity that a dimension is read from; none where the row itself can look it up."""
        d = self.package.dimensions.get(dimension)
        if d is None or d.entity in self.joined or lookups(self.package, self.start, d.entity):
            return None
        try:
            child_route(self.package, self.start, d.entity, self.routes)
            return d.entity
        except SemanticError as e:
            if e.code != "PATH_NOT_FOUND":
                raise
        found = [r.source for r in self.package.relationships if r.target == self.start and lookups(self.package, r.source, d.entity)]
        return found[0] if len(found) == 1 else None

    def entity_filter(self, c: dict) -> None:
        """{"any"/"none": child, "where": [...]}: some or no child row meets all conditions together."""
        if "having" in c:
            entity = c["entity"]
            if "over" not in c:
                raise SemanticError("ENTITY_FILTER_PERIOD_UNSTATED", "state the time that the threshold is over: all_time or a window")
        else:
            entity = c.get("entity", self.start)
        self.reach(entity)
        key = self.package.entities[entity].key
        if not key:
            raise SemanticError("ROW_GRAIN_UNSUPPORTED", f"{entity} has no key")
        mine = [F.col(f"{entity}${k}") for k in key]
        if "having" in c:
            picked, kind = self._threshold(c, entity, key)
            same = [self.dimension(g) for g in c.get("context", [])]
            beside = [F.col(f"__x{i}") for i in range(len(same))]
            if c["over"] == "period":
                same, beside = [*same, self.period[1]], [*beside, F.col("__period")]
            self.df = self.df.join(picked, [m == F.col(f"__k{i}") for i, m in enumerate(mine)] + [a.eqNullSafe(b) for a, b in zip(same, beside, strict=True)], kind)
            return
        else:
            child = c.get("any") or c["none"]
            inner = Reader(self.package, self.relation, child, self.routes)
            hops = child_route(self.package, entity, child, self.routes)
            inner.where(c.get("where", []))
            for hop in hops[:-1]:
                inner.reach(hop.target)
            last = hops[-1]
            mine = [F.col(f"{entity}${b}") for _, b in last.on]
            picked = inner.df.select(*[F.col(f"{last.source}${a}").alias(f"__k{i}") for i, (a, _) in enumerate(last.on)])
            kind = "left_semi" if "any" in c else "left_anti"
        self.df = self.df.join(picked, [m == F.col(f"__k{i}") for i, m in enumerate(mine)], kind)

    def _threshold(self, c: dict, entity: str, key: tuple[str, ...]) -> tuple[DataFrame, str]:
        """Entities whose statistic meets a threshold. One that 0 meets also takes entities without rows: all but the failing ones.
        over: "all_time", a window, or "period" (each row is judged by its entity's rows of the same period of the call's series, as many
        more periods before it as `rolling` says). context: dimensions whose values are judged apart, unknown ones together."""
        name = c["having"]["id"]
        while name:  # also what a lookup measure comes down to
            if name in self.package.denied or name in self.package.withheld:
                raise SemanticError("POLICY_DENIED", f"{c['having']['id']} isn't open")
            if name not in self.package.measures:
                raise SemanticError("OBJECT_NOT_FOUND", f"no measure {name}")
            name = (self.package.measures[name].lookup or (None, None))[1]
        m = self.package.measures[c["having"]["id"]]
        inner = Reader(self.package, self.relation, m.entity, self.routes)
        inner.reach(entity)
        inner.where(c.get("where", []))
        extra = [inner.dimension(g).alias(f"__x{i}") for i, g in enumerate(c.get("context", []))]
        if c["over"] == "period":
            if self.period is None or m.clock is None:
                raise SemanticError("PREDICATE_GRAIN_UNSAFE", "a threshold by period needs a series and a clock")
            grain, back = self.period[0], c.get("rolling", 1)
            own = F.date_trunc(grain, inner.clock(self.package.clocks[m.clock])).cast("date")
            step = {"week": "interval 7 days", "quarter": "interval 3 months"}.get(grain, f"interval 1 {grain}")
            inner.df = inner.df.withColumn("__own", own)  # a row counts in its period and in those that look back on it
            if back > 1:
                last = F.expr(f"cast(__own + {back - 1} * {step} as date)")
                inner.df = inner.df.withColumn("__own", F.explode(F.sequence(F.col("__own"), last, F.expr(step))))
            extra.append(F.col("__own").alias("__period"))
        elif c["over"] != "all_time":
            clock = self.package.clocks[m.clock]
            t = inner.clock(clock)
            start, end = c["over"]["start"], c["over"]["end"]
            inner.df = inner.df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz")))
        keys = [F.col(f"{entity}${k}") for k in key]
        value = inner.value(m)
        per = inner.df.where(reduce(Column.__and__, [k.isNotNull() for k in keys])).groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], *extra).agg(statistic(m.agg, value).alias("__v"))
        word, limit = c["having"].get("word", "gte"), c["having"]["value"]
        if isinstance(limit, dict):
            per = per.crossJoin(F.broadcast(per.agg(F.percentile("__v", F.lit(limit["percentile"])).alias("__limit"))))  # one row
            ok = {"gte": F.col("__v") >= F.col("__limit"), "gt": F.col("__v") > F.col("__limit"), "lt": F.col("__v") < F.col("__limit"), "lte": F.col("__v") <= F.col("__limit")}[word]
            return per.where(ok), "left_semi"
        ok = condition(F.col("__v"), word, limit)
        zero = {"is": limit == 0, "lt": 0 < limit, "lte": 0 <= limit, "gt": limit < 0, "gte": limit <= 0}.get(word, False) if not isinstance(limit, list) else 0 in limit
        if zero and m.agg in ("sum", "count", "count_distinct"):
            return per.where(F.coalesce(~ok, F.lit(True))), "left_anti"
        return per.where(ok), "left_semi"


def _prefixed(expr: str, entity: str, columns: list[str]) -> str:
    names = "|".join(sorted(map(re.escape, columns), key=len, reverse=True))
    return re.sub(rf"'[^']*'|\b({names})\b", lambda m: f"`{entity}${m[1]}`" if m[1] else m[0], expr)


def snapshot(df: DataFrame, measure: Measure, entity: str, clock: Column, bucket: Column | None, last: bool = True) -> DataFrame:
    """Of a stock's rows, those of the last (first) day of each period that has any; ties are all read."""
    df = df.withColumn("__t", clock)
    period = [bucket] if bucket is not None else [F.lit(0)]
    ends = df.groupBy(*[p.alias("__p") for p in period]).agg((F.max if last else F.min)(F.to_date("__t")).alias("__day"))
    df = df.withColumn("__p", period[0]).join(F.broadcast(ends) if bucket is None else ends, "__p").where(F.to_date("__t") == F.col("__day"))
    series = [F.col(f"{entity}${c}") for c in measure.stock or ()]
    if not series:
        return df
    w = Window.partitionBy("__p", *series).orderBy(F.desc("__t") if last else F.asc("__t"))
    return df.withColumn("__r", F.rank().over(w)).where("__r = 1")
