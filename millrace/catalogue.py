"""A package over the driver's tables, and the queries asked of it, with the SQL that says what each returns."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.pipelines import run_pipeline
from .plans.engine import Engine
from .plans.model import Clock, Dimension, Entity, Measure, Package, Relationship, Rollup
from .sources.relations import parquet_folder

MONEY = "decimal(18,2)"

DERIVED = {
    "order_loads": lambda rel: rel("region").where("r_regionkey = 0").select(F.lit("1996-08-10").cast("date").alias("through_day")),
    "orders_null": lambda rel: rel("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END").alias("o_custkey"), "o_orderpriority", "o_totalprice"),
    "user_days": lambda rel: rel("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_events")).select(F.col("user_id"), F.col("day").cast("timestamp_ntz").alias("day"), "n_events"),
    "orders_monthly": lambda rel: rel("orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"), F.count("o_orderkey").alias("orders")),
    "customer_history": lambda rel: rel("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.expr("timestamp_ntz '1990-01-01'").alias("valid_from"), F.expr("timestamp_ntz '1998-01-01'").alias("valid_to"))
    .unionByName(rel("customer").where("c_custkey % 3 <> 0").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit("+")).alias("segment"), F.expr("timestamp_ntz '1998-01-01'").alias("valid_from"), F.expr("cast(null as timestamp_ntz)").alias("valid_to"))),
}

PACKAGE = Package(
    entities={
        "region": Entity("region", ("r_regionkey",)), "nation": Entity("nation", ("n_nationkey",)), "customer": Entity("customer", ("c_custkey",)), "supplier": Entity("supplier", ("s_suppkey",)),
        "part": Entity("part", ("p_partkey",)), "order": Entity("orders", ("o_orderkey",)), "lineitem": Entity("lineitem"), "event": Entity("events", ("event_id",)),
        "order_null": Entity("orders_null", ("o_orderkey",)), "user_day": Entity("user_days", ("user_id", "day")), "history": Entity("customer_history"), "document": Entity("documents", ("doc_id",)), "label": Entity("labels", ("doc_id",)),
    },
    relationships=(
        Relationship("nation", "region", (("n_regionkey", "r_regionkey"),)), Relationship("customer", "nation", (("c_nationkey", "n_nationkey"),)), Relationship("supplier", "nation", (("s_nationkey", "n_nationkey"),)),
        Relationship("order", "customer", (("o_custkey", "c_custkey"),)), Relationship("lineitem", "order", (("l_orderkey", "o_orderkey"),)), Relationship("lineitem", "part", (("l_partkey", "p_partkey"),)),
        Relationship("lineitem", "supplier", (("l_suppkey", "s_suppkey"),)), Relationship("event", "customer", (("user_id", "c_custkey"),)), Relationship("order_null", "customer", (("o_custkey", "c_custkey"),)),
        Relationship("user_day", "customer", (("user_id", "c_custkey"),)), Relationship("order", "history", (("o_custkey", "c_custkey"),), ("valid_from", "valid_to")), Relationship("document", "label", (("doc_id", "doc_id"),)),
    ),
    dimensions={
        "region.name": Dimension("region", "r_name"), "nation.name": Dimension("nation", "n_name"), "customer.segment": Dimension("customer", "c_mktsegment"), "customer.key": Dimension("customer", "c_custkey"), "customer.name": Dimension("customer", "c_name"),
        "part.brand": Dimension("part", "p_brand"), "order.status": Dimension("order", "o_orderstatus"), "order.priority": Dimension("order", "o_orderpriority"), "order.price": Dimension("order", "o_totalprice"),
        "lineitem.flag": Dimension("lineitem", "l_returnflag"), "lineitem.quantity": Dimension("lineitem", "l_quantity"), "event.type": Dimension("event", "event_type"), "event.user": Dimension("event", "user_id"), "event.day": Dimension("event", "dayofmonth(ts)"),
        "order_null.priority": Dimension("order_null", "o_orderpriority", ("4-NOT SPECIFIED",)), "history.segment": Dimension("history", "segment"), "document.lang": Dimension("document", "lang"), "label.quality": Dimension("label", "quality"),
    },
    clocks={"order.date": Clock("order", "o_orderdate"), "lineitem.ship": Clock("lineitem", "l_shipdate"), "event.ts": Clock("event", "ts"), "user_day.day": Clock("user_day", "day"), "event.local": Clock("event", "ts", "UTC", "Asia/Kolkata")},
    measures={
        "revenue": Measure("order", f"cast(o_totalprice as {MONEY})", clock="order.date"), "orders": Measure("order", "o_orderkey", "count", clock="order.date"), "customers": Measure("order", "o_custkey", "count_distinct", clock="order.date"),
        "quantity": Measure("lineitem", f"cast(l_quantity as {MONEY})", clock="lineitem.ship"), "line_value": Measure("lineitem", f"cast(l_extendedprice as {MONEY})", clock="lineitem.ship"), "events": Measure("event", "event_id", "count", clock="event.ts"),
        "event_value": Measure("event", "value", "sum", clock="event.ts"), "revenue_null": Measure("order_null", f"cast(o_totalprice as {MONEY})"), "active": Measure("user_day", "n_events", "last_value", clock="user_day.day", stock=("user_id",)),
        "customer_orders": Measure("event", "", "max", lookup=("customer", "orders"), clock="event.ts"), "documents": Measure("document", "doc_id", "count"), "characters": Measure("document", "n_chars"),
    },
    metrics={
        "aov_text": "revenue / orders",
        "aov": {"kind": "ratio", "numerator": {"kind": "measure", "id": "revenue"}, "denominator": {"kind": "measure", "id": "orders"}},
        "urgent_share": {"kind": "ratio", "numerator": {"kind": "aggregate_if", "id": "orders", "agg": "count", "if": [{"id": "order.priority", "value": "1-URGENT"}]}, "denominator": {"kind": "measure", "id": "orders"}},
    },
)


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, PACKAGE, parquet_folder(spark, sf_dir, DERIVED))


#: The same with a table of monthly sums, which the engine reads where it holds all that a call asks for.
ROLLED = replace(PACKAGE, rollups=(Rollup("orders_monthly", {"revenue": "revenue", "orders": "orders"}, {"order.status": "o_orderstatus"}, "order.date", "month", "month"),))
QUERIES: dict = {}
ORACLES: dict = {}
M = lambda i: {"kind": "measure", "id": i}


def _shaped(df: DataFrame, shape: dict[str, tuple[str, str]]) -> DataFrame:
    """Output columns by name: (column of the result, type). Doubles are rounded, so the order of a sum doesn't show."""
    typed = lambda c, t: F.floor(F.col(f"`{c}`").cast("double") * 10000 + 0.5).cast("double") / 10000 if t == "double" else F.col(f"`{c}`").cast(t)
    return df.select(*[typed(c, t).alias(n) for n, (c, t) in shape.items()])


def _ask(name: str, call: dict, shape: dict[str, tuple[str, str]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _shaped(engine(spark, sf_dir).query(call), shape)
    ORACLES[name] = sql


N, B, D, S = ("double", "bigint", "date", "string")
R = lambda x: f"floor(cast({x} as double) * 10000 + 0.5) / 10000"
REV = "sum(cast(o_totalprice as decimal(18,2)))"
OCN = "orders o LEFT JOIN customer c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey"
MON = "cast(date_trunc('month', o_orderdate) as date)"

_ask("revenue_by_nation", {"select": ["revenue", "orders"], "group_by": ["nation.name"], "routes": {"order->nation": ["customer", "nation"]}, "order_by": ["nation.name"]}, {"nation": ("nation.name", S), "revenue": ("revenue", N), "orders": ("orders", B)},
     f"SELECT n_name AS nation, {R(REV)} AS revenue, count(*) AS orders FROM {OCN} GROUP BY 1")
_ask("filter_words", {"select": ["orders"], "group_by": ["order.status"], "where": [{"id": "order.priority", "word": "not", "value": ["1-URGENT", "5-LOW"]}, {"id": "order.price", "word": "gte", "value": 1000}, {"id": "customer.segment", "word": "starts_with", "value": "b"}, {"id": "customer.name", "word": "not_contains", "value": "99"}, {"id": "order.price", "word": "missing", "value": False}]},
     {"status": ("order.status", S), "orders": ("orders", B)}, "SELECT o_orderstatus AS status, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND o_totalprice >= 1000 AND starts_with(lower(c_mktsegment), 'b') AND NOT contains(lower(c_name), '99') GROUP BY 1")
_ask("unknown_values", {"select": ["revenue_null"], "group_by": ["order_null.priority"]}, {"priority": ("order_null.priority", S), "revenue": ("revenue_null", N)}, f"SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, {R(REV)} AS revenue FROM orders GROUP BY 1")
_ask("unknown_key_lookup", {"select": ["revenue_null"], "group_by": ["customer.segment"]}, {"segment": ("customer.segment", S), "revenue": ("revenue_null", N)}, f"SELECT c_mktsegment AS segment, {R(REV)} AS revenue FROM orders LEFT JOIN customer ON CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey END = c_custkey GROUP BY 1")
_ask("distinct_listing", {"group_by": ["customer.segment", "region.name"]}, {"segment": ("customer.segment", S), "region": ("region.name", S)}, "SELECT DISTINCT c_mktsegment AS segment, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
_ask("having_top_n", {"select": ["orders", "revenue"], "group_by": ["customer.key"], "having": [{"id": "orders", "word": "gt", "value": 5}], "order_by": [{"id": "orders", "desc": True}], "limit": 20}, {"customer": ("customer.key", B), "orders": ("orders", B), "revenue": ("revenue", N)},
     f"SELECT o_custkey AS customer, count(*) AS orders, {R(REV)} AS revenue FROM orders GROUP BY 1 HAVING count(*) > 5 ORDER BY orders DESC, customer LIMIT 20")
_stat = lambda a, **k: {"id": "revenue", "as": a, "agg": a, **k}
_ask("statistics", {"select": [*map(_stat, ("avg", "min", "max", "median")), _stat("percentile", p=0.9), "customers"], "group_by": ["order.priority"]}, {"priority": ("order.priority", S), **{a: (a, N) for a in ("avg", "min", "max", "median", "percentile")}, "customers": ("customers", B)},
     f"SELECT o_orderpriority AS priority, {R('cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*)')} AS avg, {R('min(o_totalprice)')} AS min, {R('max(o_totalprice)')} AS max, {R('median(o_totalprice)')} AS median, {R('quantile_cont(o_totalprice, 0.9)')} AS percentile, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
_ask("first_last_value", {"select": [{"id": "event_value", "as": "first", "agg": "first_value"}, {"id": "event_value", "as": "last", "agg": "last_value"}], "group_by": ["event.user"]}, {"user": ("event.user", B), "first": ("first", N), "last": ("last", N)},
     f"SELECT user_id AS user, {R('arg_min(value, ts)')} AS first, {R('arg_max(value, ts)')} AS last FROM events WHERE value IS NOT NULL GROUP BY 1")
_ask("ratio_and_conditional", {"select": ["aov", "urgent_share"], "group_by": ["customer.segment"]}, {"segment": ("customer.segment", S), "aov": ("aov", N), "urgent_share": ("urgent_share", N)},
     f"SELECT c_mktsegment AS segment, {R('cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*)')} AS aov, {R('count(*) FILTER (o_orderpriority = ' + chr(39) + '1-URGENT' + chr(39) + ')::double / count(*)')} AS urgent_share FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
_ask("arithmetic_and_calls", {"select": [{"as": "x", "expr": {"kind": "call", "name": "ROUND", "args": [{"kind": "divide", "args": [{"kind": "subtract", "args": [M("revenue"), M("orders")]}, {"kind": "literal", "value": 1000}]}, 1]}}], "group_by": ["order.status"]}, {"status": ("order.status", S), "x": ("x", N)},
     f"SELECT o_orderstatus AS status, {R('round(cast(' + REV + ' - count(*) as double) / 1000, 1)')} AS x FROM orders GROUP BY 1")
_ask("two_leaves", {"select": ["orders", "quantity"], "group_by": ["customer.segment"]}, {"segment": ("customer.segment", S), "orders": ("orders", B), "quantity": ("quantity", N)},
     f"SELECT * FROM (SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS segment, {R('sum(l_quantity)')} AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1) USING (segment)")
_ask("child_group_counts_once", {"select": ["revenue", "orders"], "group_by": ["part.brand"]}, {"brand": ("part.brand", S), "revenue": ("revenue", N), "orders": ("orders", B)},
     f"SELECT brand, {R(REV)} AS revenue, count(*) AS orders FROM (SELECT DISTINCT o_orderkey, o_totalprice, p_brand AS brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) GROUP BY 1")
_big = [{"id": "lineitem.flag", "value": "R"}, {"id": "lineitem.quantity", "word": "gt", "value": 45}]
_ask("any_child", {"select": ["orders"], "group_by": ["order.status"], "where": [{"any": "lineitem", "where": _big}]}, {"status": ("order.status", S), "orders": ("orders", B)}, "SELECT o_orderstatus AS status, count(*) AS orders FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45) GROUP BY 1")
_ask("no_child", {"select": ["orders"], "group_by": ["order.status"], "where": [{"none": "lineitem", "where": _big}]}, {"status": ("order.status", S), "orders": ("orders", B)}, "SELECT o_orderstatus AS status, count(*) AS orders FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 45) GROUP BY 1")
_per = "(SELECT o_custkey AS k, count(*) AS v FROM orders {w} GROUP BY 1)"
for _name, _having, _over, _sql in (
    ("threshold_all_time", {"id": "orders", "value": 10}, "all_time", f"o_custkey IN (SELECT k FROM {_per.format(w='')} WHERE v >= 10)"),
    ("threshold_in_window", {"id": "orders", "value": 3}, {"start": "1996-01-01", "end": "1997-01-01"}, "o_custkey IN (SELECT k FROM " + _per.format(w="WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'") + " WHERE v >= 3)"),
    ("threshold_that_zero_meets", {"id": "orders", "word": "lt", "value": 2}, {"start": "1996-01-01", "end": "1997-01-01"}, "o_custkey NOT IN (SELECT k FROM " + _per.format(w="WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'") + " WHERE NOT v < 2)"),
    ("threshold_percentile", {"id": "orders", "value": {"percentile": 0.9}}, "all_time", f"o_custkey IN (SELECT k FROM {_per.format(w='')} WHERE v >= (SELECT quantile_cont(v, 0.9) FROM {_per.format(w='')}))"),
):
    _ask(_name, {"select": ["revenue"], "group_by": ["customer.segment"], "where": [{"entity": "customer", "having": _having, "over": _over}]}, {"segment": ("customer.segment", S), "revenue": ("revenue", N)},
         f"SELECT c_mktsegment AS segment, {R(REV)} AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE {_sql} GROUP BY 1")
_ask("monthly_series", {"select": ["orders"], "time": {"grain": "month", "start": "1995-06-01", "end": "1996-06-01"}, "group_by": ["order.status"]}, {"period": ("period", D), "status": ("order.status", S), "orders": ("orders", B)},
     f"WITH s AS (SELECT cast(unnest(generate_series(DATE '1995-06-01', DATE '1996-05-01', INTERVAL 1 MONTH)) AS DATE) AS period), f AS (SELECT {MON} AS period, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderdate >= '1995-06-01' AND o_orderdate < '1996-06-01' GROUP BY ALL) SELECT s.period, g.status, coalesce(f.n, 0) AS orders FROM s CROSS JOIN (SELECT DISTINCT status FROM f) g LEFT JOIN f ON f.period = s.period AND f.status = g.status")
_ask("relative_window", {"select": ["orders", {"id": "revenue", "as": "mean", "agg": "avg"}], "time": {"grain": "week", "now": "1996-02-14", "last": {"unit": "week", "value": 8}}}, {"period": ("period", D), "orders": ("orders", B), "mean": ("mean", N)},
     f"SELECT cast(date_trunc('week', o_orderdate) as date) AS period, count(*) AS orders, {R('cast(sum(cast(o_totalprice as decimal(18,2))) as double) / count(*)')} AS mean FROM orders WHERE o_orderdate >= '1995-12-18' AND o_orderdate < '1996-02-12' GROUP BY 1")
_ask("window_total", {"select": ["revenue"], "time": {"start": "1996-01-01", "end": "1996-07-01"}, "group_by": ["region.name"], "routes": {"order->region": ["customer", "nation", "region"]}}, {"region": ("region.name", S), "revenue": ("revenue", N)},
     f"SELECT r_name AS region, {R(REV)} AS revenue FROM {OCN} JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1996-07-01' GROUP BY 1")
_w = lambda k, i=M("revenue"), **x: {"as": k, "expr": {"kind": k, "input": i, **x}}
_MS = f"WITH f AS (SELECT {MON} AS period, c_mktsegment AS segment, {REV} AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT cast(unnest(generate_series((SELECT min(period) FROM f), (SELECT max(period) FROM f), INTERVAL 1 MONTH)) AS DATE) AS period), d AS (SELECT s.period, g.segment, coalesce(f.v, 0) AS v, coalesce(f.n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT segment FROM f) g LEFT JOIN f ON f.period = s.period AND f.segment = g.segment) "
_ask("look_backs", {"select": [_w("rolling", unit="month", value=3), _w("prior_period", unit="year", value=1), _w("cumulative"), _w("period_to_date", period="year")], "time": {"grain": "month"}, "group_by": ["customer.segment"]},
     {"period": ("period", D), "segment": ("customer.segment", S), **{k: (k, N) for k in ("rolling", "prior_period", "cumulative", "period_to_date")}},
     _MS + f"SELECT period, segment, {R('sum(v) OVER (w ROWS 2 PRECEDING)')} AS rolling, {R('lag(v, 12) OVER w')} AS prior_period, {R('sum(v) OVER (w ROWS UNBOUNDED PRECEDING)')} AS cumulative, {R('sum(v) OVER (PARTITION BY segment, year(period) ORDER BY period ROWS UNBOUNDED PRECEDING)')} AS period_to_date FROM d WINDOW w AS (PARTITION BY segment ORDER BY period)")
_ask("rolling_ratio", {"select": [{"as": "rolling", "expr": {"kind": "rolling", "input": PACKAGE.metrics["aov"], "unit": "quarter", "value": 1}}], "time": {"grain": "month"}, "group_by": ["customer.segment"]}, {"period": ("period", D), "segment": ("customer.segment", S), "rolling": ("rolling", N)},
     _MS + f"SELECT period, segment, {R('cast(sum(v) OVER w as double) / nullif(sum(n) OVER w, 0)')} AS rolling FROM d WINDOW w AS (PARTITION BY segment ORDER BY period ROWS 2 PRECEDING)")
_rn = {"order->region": ["customer", "nation", "region"], "order->nation": ["customer", "nation"]}
_ask("share_and_total", {"select": ["revenue", _w("share", over=["nation.name"]), {"as": "buyers", "expr": {"kind": "total", "input": M("customers"), "over": ["nation.name"]}}], "group_by": ["region.name", "nation.name"], "routes": _rn}, {"region": ("region.name", S), "nation": ("nation.name", S), "share": ("share", N), "buyers": ("buyers", B)},
     f"WITH f AS (SELECT r_name AS region, n_name AS nation, {REV} AS v FROM {OCN} JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), t AS (SELECT r_name AS region, count(DISTINCT o_custkey) AS buyers FROM {OCN} JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) SELECT region, nation, {R('cast(v as double) / cast(sum(v) OVER (PARTITION BY region) as double)')} AS share, buyers FROM f JOIN t USING (region)")
_ask("totals_rows", {"select": ["customers"], "group_by": ["region.name", "order.status"], "totals": ["region.name", "order.status"], "routes": _rn}, {"region": ("region.name", S), "status": ("order.status", S), "customers": ("customers", B)},
     f"SELECT r_name AS region, o_orderstatus AS status, count(DISTINCT o_custkey) AS customers FROM {OCN} JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, o_orderstatus)")
_ask("distribution", {"select": [{"as": "median", "expr": {"kind": "distribution", "agg": "median", "entity": "customer", "input": M("revenue")}}, {"as": "p80", "expr": {"kind": "distribution", "agg": "percentile", "p": 0.8, "entity": "customer", "input": M("revenue")}}], "group_by": ["customer.segment"]}, {"segment": ("customer.segment", S), "median": ("median", N), "p80": ("p80", N)},
     f"SELECT segment, {R('median(v)')} AS median, {R('quantile_cont(v, 0.8)')} AS p80 FROM (SELECT c_mktsegment AS segment, c_custkey, cast({REV} as double) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1")
_ask("conversion", {"select": [{"as": "rate", "expr": {"kind": "conversion", "base": {"id": "events", "where": [{"id": "event.type", "value": "view"}]}, "converted": {"id": "events", "where": [{"id": "event.type", "value": "purchase"}]}, "entity": "event.user", "matching_mode": "first_converted_after_base", "window": {"unit": "day", "value": 2}}}], "group_by": ["customer.segment"]}, {"segment": ("customer.segment", S), "rate": ("rate", N)},
     f"SELECT c_mktsegment AS segment, {R('avg(CASE WHEN EXISTS (FROM events p WHERE p.event_type = ' + chr(39) + 'purchase' + chr(39) + ' AND p.user_id = v.user_id AND p.ts >= v.ts AND p.ts < v.ts + INTERVAL 2 DAY) THEN 1.0 ELSE 0.0 END)')} AS rate FROM events v JOIN customer ON v.user_id = c_custkey WHERE v.event_type = 'view' GROUP BY 1")
_ask("stock_closing_day", {"select": ["active"], "time": {"grain": "week", "start": "2024-01-01", "end": "2024-01-29"}, "group_by": ["customer.segment"]}, {"period": ("period", D), "segment": ("customer.segment", S), "active": ("active", B)},
     "WITH u AS (SELECT user_id, cast(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-29' GROUP BY ALL), w AS (SELECT *, cast(date_trunc('week', day) AS DATE) AS period FROM u), e AS (SELECT period, max(day) AS day FROM w GROUP BY 1), f AS (SELECT w.period, c_mktsegment AS segment, sum(n) AS active FROM w JOIN e USING (period, day) JOIN customer ON user_id = c_custkey GROUP BY ALL) SELECT p.period, g.segment, cast(f.active AS BIGINT) AS active FROM (SELECT DISTINCT period FROM w) p CROSS JOIN (SELECT DISTINCT segment FROM f) g LEFT JOIN f ON f.period = p.period AND f.segment = g.segment")
_ask("history_join", {"select": ["revenue"], "time": {"start": "1997-01-01", "end": "1999-01-01"}, "group_by": ["history.segment"]}, {"segment": ("history.segment", S), "revenue": ("revenue", N)},
     f"WITH h AS (SELECT c_custkey, c_mktsegment AS segment, TIMESTAMP '1990-01-01' AS a, TIMESTAMP '1998-01-01' AS b FROM customer UNION ALL SELECT c_custkey, c_mktsegment || '+', TIMESTAMP '1998-01-01', NULL FROM customer WHERE c_custkey % 3 <> 0) SELECT segment, {R(REV)} AS revenue FROM orders LEFT JOIN h ON o_custkey = c_custkey AND a <= o_orderdate AND (b IS NULL OR b > o_orderdate) WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1999-01-01' GROUP BY 1")
_ask("joined_parts", {"parts": [{"select": ["orders"], "group_by": ["customer.key"]}, {"select": ["events"], "group_by": ["customer.key"], "where": [{"id": "event.type", "value": "purchase"}]}], "join": [["customer.key"], ["customer.key"]]}, {"customer": ("key0", B), "orders": ("orders", B), "events": ("events", B), "has_events": ("in1", "boolean")},
     "SELECT coalesce(a.k, b.k) AS customer, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS events, b.k IS NOT NULL AS has_events FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.k = b.k")
_ask("lookup_with_misses", {"select": ["documents", "characters"], "group_by": ["document.lang", "label.quality"]}, {"lang": ("document.lang", S), "quality": ("label.quality", B), "documents": ("documents", B), "characters": ("characters", B)}, "SELECT lang, cast(quality AS BIGINT) AS quality, count(*) AS documents, cast(sum(n_chars) AS BIGINT) AS characters FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")

_ask("plain_child_condition", {"select": ["orders"], "group_by": ["order.status"], "where": [{"id": "lineitem.quantity", "word": "gt", "value": 49}, {"id": "order.price", "word": "gt", "value": 1000}]}, {"status": ("order.status", S), "orders": ("orders", B)},
     "SELECT o_orderstatus AS status, count(*) AS orders FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) AND o_totalprice > 1000 GROUP BY 1")
QUERIES["withheld_ranking"] = lambda spark, sf_dir: _shaped(Engine(spark, replace(PACKAGE, withheld={"revenue": 10}), parquet_folder(spark, sf_dir, DERIVED)).query({"select": ["revenue", "orders"], "group_by": ["customer.key"], "order_by": [{"id": "revenue", "desc": True}], "limit": 10}), {"customer": ("customer.key", B), "orders": ("orders", B)})
ORACLES["withheld_ranking"] = f"SELECT o_custkey AS customer, count(*) AS orders FROM orders GROUP BY 1 ORDER BY {REV} DESC, 1 LIMIT 10"
_ask("single_value", {"select": [{"id": "customers", "as": "customer", "agg": "single_value"}], "group_by": ["order.price"]}, {"price": ("order.price", N), "customer": ("customer", B)},
     f"SELECT {R('o_totalprice')} AS price, CASE WHEN min(o_custkey) = max(o_custkey) THEN max(o_custkey) END AS customer FROM orders GROUP BY o_totalprice")
_ask("parent_lookup", {"select": [{"id": "customer_orders", "as": "most"}, {"id": "customer_orders", "as": "mean", "agg": "avg"}], "group_by": ["event.type"]}, {"type": ("event.type", S), "most": ("most", B), "mean": ("mean", N)},
     f"SELECT event_type AS type, max(n) AS most, {R('cast(sum(n) as double) / count(n)')} AS mean FROM (SELECT event_type, CASE WHEN c_custkey IS NOT NULL THEN coalesce(n, 0) END AS n FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) GROUP BY 1")
_ask("clock_zone", {"select": ["events"], "time": {"grain": "day", "clock": "event.local"}, "group_by": ["event.type"]}, {"period": ("period", D), "type": ("event.type", S), "events": ("events", B)},
     "SELECT cast(ts + INTERVAL 330 MINUTE AS DATE) AS period, event_type AS type, count(*) AS events FROM events GROUP BY ALL")
QUERIES["rollup_routing"] = lambda spark, sf_dir: _shaped(Engine(spark, ROLLED, parquet_folder(spark, sf_dir, DERIVED)).query({"select": ["revenue", "orders"], "time": {"grain": "quarter", "start": "1996-01-01", "end": "1999-01-01"}, "group_by": ["order.status"]}), {"period": ("period", D), "status": ("order.status", S), "revenue": ("revenue", N), "orders": ("orders", B)})
ORACLES["rollup_routing"] = f"WITH s AS (SELECT cast(unnest(generate_series(DATE '1996-01-01', DATE '1998-10-01', INTERVAL 3 MONTH)) AS DATE) AS period), f AS (SELECT cast(date_trunc('quarter', o_orderdate) as date) AS period, o_orderstatus AS status, {REV} AS v, count(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1999-01-01' GROUP BY ALL) SELECT s.period, g.status, {R('coalesce(f.v, 0)')} AS revenue, coalesce(f.n, 0) AS orders FROM s CROSS JOIN (SELECT DISTINCT status FROM f) g LEFT JOIN f ON f.period = s.period AND f.status = g.status"
QUERIES["valid_values"] = lambda spark, sf_dir: engine(spark, sf_dir).values("part.brand", contains="brand", limit=10, offset=5).select(F.col("value").alias("brand"))
ORACLES["valid_values"] = "SELECT DISTINCT p_brand AS brand FROM part WHERE contains(lower(p_brand), 'brand') ORDER BY 1 LIMIT 10 OFFSET 5"


_ev = lambda kind: {"id": "events", "where": [{"id": "event.type", "value": kind}]}
_conv = {"kind": "conversion", "base": _ev("view"), "converted": _ev("purchase"), "entity": "event.user", "matching_mode": "closest_converted_after_base", "window": {"unit": "day", "value": 3}}
_VP = "events v JOIN events p ON p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts AND p.ts < v.ts + INTERVAL 3 DAY"
_ask("conversion_by_converted", {"select": [{"as": "rate", "expr": {**_conv, "dimension_bindings": {"event.day": "converted"}}}], "group_by": ["customer.segment", "event.day"]}, {"segment": ("customer.segment", S), "day": ("event.day", B), "rate": ("rate", N)},
     f"WITH m AS (SELECT v.event_id, v.user_id, p.ts, rank() OVER (PARTITION BY v.event_id ORDER BY p.ts) AS r FROM {_VP} WHERE v.event_type = 'view'), n AS (SELECT c_mktsegment AS segment, dayofmonth(ts) AS day, count(DISTINCT event_id) AS n FROM m LEFT JOIN customer ON user_id = c_custkey WHERE r = 1 GROUP BY ALL), d AS (SELECT c_mktsegment AS segment, count(*) AS d FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type = 'view' GROUP BY ALL) SELECT n.segment, day, {R('n::double / d')} AS rate FROM n JOIN d ON n.segment IS NOT DISTINCT FROM d.segment")
_ask("conversion_constant_property", {"select": [{"as": "rate", "expr": {**_conv, "constant_properties": ["event.day"]}}]}, {"rate": ("rate", N)},
     f"SELECT {R('(SELECT count(DISTINCT v.event_id) FROM ' + _VP + ' AND dayofmonth(p.ts) = dayofmonth(v.ts) WHERE v.event_type = ' + chr(39) + 'view' + chr(39) + ')::double / count(*)')} AS rate FROM events WHERE event_type = 'view'")
_ask("child_values", {"select": ["events"], "group_by": ["order.status"]}, {"status": ("order.status", S), "events": ("events", B)},
     "SELECT status, count(*) AS events FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey, o_orderstatus AS status FROM orders) ON o_custkey = c_custkey GROUP BY 1")
FORWARD = replace(PACKAGE, relationships=tuple(replace(r, forward=(r.source, r.target) == ("order", "customer")) for r in PACKAGE.relationships), measures=PACKAGE.measures | {"people": Measure("customer", "c_custkey", "count"), "balance": Measure("customer", f"cast(c_acctbal as {MONEY})")})
QUERIES["parent_value"] = lambda spark, sf_dir: _shaped(Engine(spark, FORWARD, parquet_folder(spark, sf_dir, DERIVED)).query({"select": ["people", "balance"], "group_by": ["order.priority"]}), {"priority": ("order.priority", S), "people": ("people", B), "balance": ("balance", N)})
ORACLES["parent_value"] = f"SELECT priority, count(c_custkey) AS people, {R('sum(cast(c_acctbal as decimal(18,2)))')} AS balance FROM (SELECT DISTINCT o_orderpriority AS priority, c_custkey, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey) GROUP BY 1"
_ask("same_child_groups", {"select": ["orders"], "group_by": ["lineitem.flag", "lineitem.quantity"]}, {"flag": ("lineitem.flag", S), "quantity": ("lineitem.quantity", N), "orders": ("orders", B)},
     f"SELECT l_returnflag AS flag, {R('l_quantity')} AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, l_quantity")
_ask("threshold_by_period", {"select": ["revenue"], "group_by": ["order.status"], "time": {"grain": "year"}, "where": [{"entity": "customer", "having": {"id": "orders", "value": 3}, "over": "period"}]}, {"period": ("period", D), "status": ("order.status", S), "revenue": ("revenue", N)},
     f"WITH y AS (SELECT *, cast(date_trunc('year', o_orderdate) AS DATE) AS period FROM orders) SELECT period, o_orderstatus AS status, {R(REV)} AS revenue FROM y WHERE (o_custkey, period) IN (SELECT (o_custkey, period) FROM y GROUP BY o_custkey, period HAVING count(*) >= 3) GROUP BY 1, 2")
_ask("threshold_rolling_in_context", {"select": ["orders"], "time": {"grain": "month"}, "where": [{"entity": "customer", "having": {"id": "orders", "value": 2}, "over": "period", "rolling": 3, "context": ["order.status"]}]}, {"period": ("period", D), "orders": ("orders", B)},
     "WITH m AS (SELECT *, cast(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders) SELECT period, count(*) AS orders FROM m WHERE (SELECT count(*) FROM m x WHERE x.o_custkey = m.o_custkey AND x.o_orderstatus = m.o_orderstatus AND x.period <= m.period AND x.period > m.period - INTERVAL 3 MONTH) >= 2 GROUP BY 1")
LOADED = replace(PACKAGE, entities=PACKAGE.entities | {"order": replace(PACKAGE.entities["order"], zero_through=("loaded", "order_loads", "through_day"))})
QUERIES["loaded_edge"] = lambda spark, sf_dir: _shaped(Engine(spark, LOADED, parquet_folder(spark, sf_dir, DERIVED)).query({"select": ["orders"], "time": {"grain": "month", "start": "1996-01-01", "end": "1997-01-01"}, "where": [{"id": "order.price", "word": "gt", "value": 499000}]}), {"period": ("period", D), "orders": ("orders", B)})
ORACLES["loaded_edge"] = f"WITH f AS (SELECT {MON} AS period, count(*) AS n FROM orders WHERE o_totalprice > 499000 AND o_orderdate >= '1996-01-01' AND o_orderdate < '1996-08-11' GROUP BY 1) SELECT s.period, CASE WHEN s.period < DATE '1996-08-01' OR n IS NOT NULL THEN coalesce(n, 0) END AS orders FROM (SELECT cast(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS DATE) AS period) s LEFT JOIN f USING (period)"
_ask("expression_kinds", {"select": [{"as": "x", "expr": {"kind": "case", "args": [{"kind": "boolean", "op": "or", "args": [{"kind": "between", "args": [M("orders"), {"kind": "literal", "value": 1}, {"kind": "literal", "value": 5}]}, {"kind": "in", "args": [M("orders"), [10, 11]]}]}, {"kind": "metric", "id": "aov_text"}, {"kind": "nullif", "args": [M("orders"), {"kind": "literal", "value": 7}]}]}}, {"as": "urgent", "expr": {"kind": "scoped_aggregate", "id": "orders", "where": [{"id": "order.priority", "value": "1-URGENT"}]}}], "group_by": ["customer.key"]},
     {"customer": ("customer.key", B), "x": ("x", N), "urgent": ("urgent", B)}, f"SELECT o_custkey AS customer, {R('CASE WHEN count(*) BETWEEN 1 AND 5 OR count(*) IN (10, 11) THEN ' + REV + '::double / count(*) ELSE nullif(count(*), 7) END')} AS x, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1")


#: With measures of texts and days, and a table with a key of two columns.
TEXTS = replace(
    PACKAGE, entities=PACKAGE.entities | {"market": Entity("markets", ("nation", "segment"))}, relationships=(*PACKAGE.relationships, Relationship("customer", "market", (("c_nationkey", "nation"), ("c_mktsegment", "segment")))),
    dimensions=PACKAGE.dimensions | {"market.people": Dimension("market", "people")},
    measures=PACKAGE.measures | {"name": Measure("customer", "c_name", "min"), "day": Measure("order", "o_orderdate", "max", clock="order.date"), "props": Measure("event", "props", "min", clock="event.ts")},
)
DERIVED["markets"] = lambda rel: rel("customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("people"))


def _ask_texts(name: str, call: dict, shape: dict[str, tuple[str, str]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _shaped(Engine(spark, TEXTS, parquet_folder(spark, sf_dir, DERIVED)).query(call), shape)
    ORACLES[name] = sql


_c = lambda alias, name, *args: {"as": alias, "expr": {"kind": "call", "name": name, "args": list(args)}}
_call = lambda name, *args: _c("", name, *args)["expr"]
_first, _last = ({"kind": "aggregate", "id": "day", "agg": a} for a in ("min", "max"))
_ask_texts("composite_key", {"select": ["orders"], "group_by": ["market.people"]}, {"people": ("market.people", B), "orders": ("orders", B)},
           "SELECT people, count(*) AS orders FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT c_nationkey AS nk, c_mktsegment AS sg, count(*) AS people FROM customer GROUP BY ALL) ON nk = c_nationkey AND sg = c_mktsegment GROUP BY 1")
_ask_texts("text_calls", {"select": [_c("upper", "UPPER", M("name")), _c("part", "SUBSTRING", M("name"), 2, 4), _c("swapped", "REPLACE", M("name"), "#", "; "), _c("sides", "CONCAT", _call("LEFT", M("name"), 3), "-", _call("LOWER", _call("RIGHT", M("name"), 2))), _c("length", "LENGTH", _call("TRIM", M("name"))), _c("parts", "STRING_SPLIT", M("name"), "#"), _c("number", "CAST", _call("RIGHT", M("name"), 9), "INTEGER")], "group_by": ["customer.segment"]},
           {"segment": ("customer.segment", S), **{a: (a, S) for a in ("upper", "part", "swapped", "sides", "parts")}, "length": ("length", B), "number": ("number", B)},
           "SELECT c_mktsegment AS segment, upper(n) AS upper, substring(n, 2, 4) AS part, replace(n, '#', '; ') AS swapped, left(n, 3) || '-' || lower(right(n, 2)) AS sides, length(trim(n)) AS length, cast(string_split(n, '#') AS VARCHAR) AS parts, cast(right(n, 9) AS BIGINT) AS number FROM (SELECT c_mktsegment, min(c_name) AS n FROM customer GROUP BY 1)")
_ask_texts("date_calls", {"select": [_c("months", "DATE_DIFF", "month", _first, _last), _c("weeks", "DATE_DIFF", "week", _first, _last), _c("quarter", "DATE_TRUNC", "quarter", _last), _c("year", "DATE_PART", "year", _first), {"as": "later", "expr": {"kind": "date_add", "unit": "month", "value": 2, "args": [_first]}}], "group_by": ["customer.key"]},
           {"customer": ("customer.key", B), "months": ("months", B), "weeks": ("weeks", B), "quarter": ("quarter", D), "year": ("year", B), "later": ("later", D)},
           "SELECT o_custkey AS customer, date_diff('month', a, b) AS months, date_diff('day', a, b) // 7 AS weeks, cast(date_trunc('quarter', b) AS DATE) AS quarter, year(a) AS year, cast(a + INTERVAL 2 MONTH AS DATE) AS later FROM (SELECT o_custkey, cast(min(o_orderdate) AS DATE) AS a, cast(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1)")
_ask_texts("json_calls", {"select": [_c("k", "JSON_EXTRACT_STRING", M("props"), "$.k"), _c("none", "JSON_EXTRACT", M("props"), "$.absent")], "group_by": ["event.user"]}, {"user": ("event.user", B), "k": ("k", S), "none": ("none", S)},
           "SELECT user_id AS user, json_extract_string(min(props), '$.k') AS k, json_extract_string(min(props), '$.absent') AS none FROM events GROUP BY 1")
_ask("inline_reads", {"select": [{"as": "closing", "expr": {"kind": "semi_additive", "id": "active"}}], "time": {"start": "2024-01-01", "end": "2024-02-01"}, "group_by": ["customer.segment"]}, {"segment": ("customer.segment", S), "closing": ("closing", B)},
     "WITH u AS (SELECT user_id, cast(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY ALL) SELECT c_mktsegment AS segment, cast(sum(n) FILTER (day = (SELECT max(day) FROM u)) AS BIGINT) AS closing FROM u JOIN customer ON user_id = c_custkey WHERE day = (SELECT max(day) FROM u) GROUP BY 1")
_ask("window_within_groups", {"select": [_w("cumulative", {"kind": "aggregate", "id": "revenue", "agg": "count"}, partition_by=["customer.segment"])], "time": {"grain": "month"}, "group_by": ["customer.segment"]}, {"period": ("period", D), "segment": ("customer.segment", S), "cumulative": ("cumulative", B)},
     _MS + "SELECT period, segment, cast(sum(n) OVER (PARTITION BY segment ORDER BY period) AS BIGINT) AS cumulative FROM d")
_ask("filter_aliases", {"select": ["revenue_null"], "group_by": ["order_null.priority"], "where": [{"id": "order_null.priority", "word": "missing", "value": False}, {"id": "order_null.priority", "word": "!=", "value": "5-LOW"}, {"id": "order_null.priority", "word": "not_ends_with", "value": ["urgent", "HIGH"]}]}, {"priority": ("order_null.priority", S), "revenue": ("revenue_null", N)},
     f"SELECT o_orderpriority AS priority, {R(REV)} AS revenue FROM orders WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') AND NOT regexp_matches(lower(o_orderpriority), '(urgent|high)$') GROUP BY 1")


def _pipe(name: str, steps: list[dict], shape: dict[str, tuple[str, str]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _shaped(run_pipeline(spark, parquet_folder(spark, sf_dir, DERIVED), steps), shape)
    ORACLES[name] = sql


_pipe("pipeline_json_window", [{"source": {"relation": "events"}}, {"where": [{"column": "event_type", "word": "is", "value": ["view", "click"]}]}, {"json_extract": {"column": "props", "path": ["k"], "as": "k"}}, {"window": {"nth": {"function": "row_number", "partition_by": ["user_id"], "order_by": ["ts", "event_id"]}}}, {"where": ["nth <= 3"]}, {"select": {"columns": {"event_id": "event_id", "k": "k", "nth": "nth"}}}],
      {"event_id": ("event_id", B), "k": ("k", S), "nth": ("nth", B)}, "SELECT event_id, k, nth FROM (SELECT event_id, json_extract_string(props, '$.k') AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('view', 'click')) WHERE nth <= 3")
_pipe("pipeline_pre_aggregated_join", [{"source": {"relation": "customer"}}, {"join": {"relation": "orders", "pre_aggregate": {"dimensions": ["o_custkey"], "aggregates": {"n": {"fn": "count"}, "status": {"fn": "single_value", "expr": "o_orderstatus"}}}, "on": [{"left": "c_custkey", "right": "o_custkey"}], "type": "left", "select": {"c_custkey": "c_custkey", "n": "n", "status": "status"}}}],
      {"customer": ("c_custkey", B), "n": ("n", B), "status": ("status", S)}, "SELECT c_custkey AS customer, n, status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN max(o_orderstatus) END AS status FROM orders GROUP BY 1) ON c_custkey = o_custkey")
_pipe("pipeline_anti_join", [{"source": {"relation": "orders", "columns": ["o_orderkey", "o_custkey"]}}, {"anti_join": {"relation": "lineitem", "on": [{"left": "o_orderkey", "right": "l_orderkey"}], "where": ["l_quantity > 10"]}}], {"o_orderkey": ("o_orderkey", B)}, "SELECT o_orderkey FROM orders WHERE NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)")
_pipe("pipeline_union_explode", [{"union_all": {"branches": [{"relation": "nation", "columns": ["n_name"]}, {"relation": "region", "columns": ["r_name"]}], "as": ["n_name"]}}, {"explode": {"column": "n_name", "delimiter": " ", "as": "word"}}, {"group_by": {"dimensions": ["word"], "aggregates": {"n": {"fn": "count"}}}}], {"word": ("word", S), "n": ("n", B)},
      "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(x, ' ')) AS word FROM (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region)) GROUP BY 1")
_pipe("pipeline_attribution", [{"source": {"relation": "events", "columns": ["event_id", "user_id", "ts", "event_type"]}}, {"where": ["event_type = 'signup'"]}, {"attribution_join": {"relation": "orders", "on": [{"left": "user_id", "right": "o_custkey"}], "base_time": "ts", "attributed_time": "o_orderdate", "lookback": {"unit": "day", "value": 30}, "select": {"event_id": "event_id", "o_orderkey": "o_orderkey"}}}],
      {"event_id": ("event_id", B), "order": ("o_orderkey", B)}, "SELECT event_id, o_orderkey AS \"order\" FROM events LEFT JOIN orders ON user_id = o_custkey AND o_orderdate >= ts AND date_diff('day', ts, o_orderdate) <= 30 WHERE event_type = 'signup'")
_pipe("pipeline_semi_join", [{"source": {"relation": "orders", "columns": ["o_orderkey", "o_custkey"]}}, {"semi_join": {"relation": "lineitem", "on": [{"left": "o_orderkey", "right": "l_orderkey"}], "where": ["l_quantity > 45"]}}], {"o_orderkey": ("o_orderkey", B)}, "SELECT o_orderkey FROM orders WHERE EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
_pipe("pipeline_date_spine", [{"date_spine": {"start": "1995-01-01", "end": "2005-12-31", "max_days": 5000}}, {"join": {"relation": "orders", "pre_aggregate": {"dimensions": ["o_orderdate"], "aggregates": {"n": {"fn": "count"}}}, "on": [{"left": "day", "right": "o_orderdate"}], "type": "left", "select": {"day": "day", "n": "n"}}}],
      {"day": ("day", D), "n": ("n", B)}, "SELECT cast(d AS DATE) AS day, n FROM generate_series(DATE '1995-01-01', DATE '2005-12-31', INTERVAL 1 DAY) t(d) LEFT JOIN (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) ON o_orderdate = d")
_pipe("pipeline_state_as_of", [{"date_spine": {"start": "1997-12-28", "end": "1998-01-03"}}, {"state_as_of": {"relation": "customer_history", "spine": "day", "valid_from": "valid_from", "valid_to": "valid_to", "columns": ["c_custkey", "segment"]}}, {"group_by": {"dimensions": ["day", "segment"], "aggregates": {"n": {"fn": "count"}}}}],
      {"day": ("day", D), "segment": ("segment", S), "n": ("n", B)}, "WITH h AS (SELECT c_mktsegment AS segment, DATE '1990-01-01' AS a, DATE '1998-01-01' AS b FROM customer UNION ALL SELECT c_mktsegment || '+', DATE '1998-01-01', NULL FROM customer WHERE c_custkey % 3 <> 0) SELECT cast(d AS DATE) AS day, segment, count(*) AS n FROM generate_series(DATE '1997-12-28', DATE '1998-01-03', INTERVAL 1 DAY) t(d) JOIN h ON a <= d AND (b IS NULL OR b > d) GROUP BY ALL")


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["revenue_by_nation"](spark, sf_dir)
