"""Rules of calls on small tables made here: clocks, stocks, joined calls, closed measures and pipelines."""

from dataclasses import replace
from datetime import date, datetime

import pytest

from millrace.catalogue import DERIVED, PACKAGE, engine
from millrace.errors import SemanticError
from millrace.operators.pipelines import run_pipeline
from millrace.plans.engine import Engine
from millrace.plans.model import Clock, Dimension, Entity, Measure, Package, Relationship
from millrace.sources.relations import parquet_folder

SF = "/root/testdata/sf0.001"
LOOK_BACK = {"as": "x", "expr": {"kind": "cumulative", "input": {"kind": "measure", "id": "events"}}}


def refused(code, run):
    with pytest.raises(SemanticError) as e:
        run()
    assert e.value.code == code


@pytest.mark.parametrize(
    ("code", "call"),
    [
        ("INVALID_QUERY", {"select": ["orders"], "time": {"grain": "year", "frm": "1996-01-01"}}),
        ("INVALID_QUERY", {"select": ["orders"], "time": {"last": {"unit": "month"}, "now": "1996-01-01"}}),
        ("INVALID_QUERY", {"select": ["orders"], "time": {"this": "fortnight", "now": "1996-01-01"}}),
        ("INVALID_QUERY", {"select": ["orders"], "time": {"start": "1996-01-01", "this": "year", "now": "1996-01-01"}}),
        ("INVALID_QUERY", {"select": ["orders"], "time": {"start": "soon"}}),
        ("INVALID_QUERY", {"select": ["orders"], "time": {"start": "1997-01-01", "end": "1996-01-01"}}),
        ("INVALID_QUERY", {"select": ["orders"], "observation_scope": "nonsense"}),
        ("MIXED_TIME_ROLES", {"select": ["orders", "quantity"], "time": {"grain": "year"}}),
        ("WINDOWED_TIME_FILTER_UNSUPPORTED", {"select": [LOOK_BACK], "time": {"grain": "month"}, "where": [{"id": "event.day", "word": "gt", "value": 5}]}),
        ("OBJECT_NOT_FOUND", {"select": ["orders"], "having": [{"id": "nope", "word": "gt", "value": 1}]}),
        ("INVALID_QUERY", {"parts": [{"select": ["orders"], "group_by": ["customer.key"]}, {"select": ["events"], "group_by": ["event.type"]}], "join": [["customer.key"], ["event.type"]]}),
        ("INVALID_QUERY", {"parts": [{"select": ["orders"], "group_by": ["customer.key"]}, {"select": ["events"]}], "join": [["customer.key"], ["customer.key"]]}),
        ("INVALID_QUERY", {"parts": [{"select": ["orders"]}], "join": [[]]}),
    ],
)
def test_refusals(spark, code, call):
    refused(code, lambda: engine(spark, SF).query(call))


def test_a_window_without_an_end_ends_at_now(spark):
    one = lambda **t: engine(spark, SF).query({"select": ["orders"], "time": t}).first()["orders"]
    assert one(start="1996-01-01", now="1996-02-01") == one(start="1996-01-01", end="1996-02-01") < one(start="1996-01-01")
    noon = Engine(spark, Package(entities={"t": Entity("t")}, clocks={"at": Clock("t", "at")}, measures={"n": Measure("t", "at", "count", clock="at")}), {"t": spark.createDataFrame([(datetime(2024, 5, 2, h),) for h in (9, 11, 13)], "at timestamp_ntz")})
    assert noon.query({"select": ["n"], "time": {"this": "month", "now": "2024-05-02T12:00:00"}}).first()["n"] == 2


def test_having_may_name_what_is_not_shown(spark):
    got = engine(spark, SF).query({"select": ["orders"], "group_by": ["customer.key"], "having": [{"id": "revenue", "word": "gt", "value": 0}, {"id": "aov", "word": "lt", "value": 0}]})
    assert got.columns == ["customer.key", "orders"] and got.count() == 0


def test_a_series_comes_in_order(spark):
    rows = engine(spark, SF).query({"select": ["orders"], "time": {"grain": "month"}, "group_by": ["order.status"]}).collect()
    keys = [(r["period"], r["order.status"]) for r in rows]
    assert keys == sorted(keys) and len(keys) > 50


def test_a_snapshot_is_chosen_before_filters(spark):
    seats = spark.createDataFrame([("a", "pro", 5, datetime(2024, 1, 1)), ("a", "free", 7, datetime(2024, 1, 2)), ("b", "pro", 3, datetime(2024, 1, 2))], "account string, plan string, seats long, day timestamp_ntz")
    package = Package(entities={"s": Entity("s", ("account", "day"))}, dimensions={"plan": Dimension("s", "plan"), "day": Dimension("s", "day")}, clocks={"day": Clock("s", "day")}, measures={"seats": Measure("s", "seats", "last_value", clock="day", stock=("account",))})
    ask = lambda **c: Engine(spark, package, {"s": seats}).query({"select": ["seats"], **c}).collect()
    assert ask(where=[{"id": "plan", "value": "pro"}])[0]["seats"] == 3
    assert ask(where=[{"id": "plan", "value": "free"}])[0]["seats"] == 7
    assert ask(where=[{"id": "day", "word": "lt", "value": "2024-01-02"}])[0]["seats"] == 5  # a filter on the clock chooses


@pytest.mark.parametrize(("rule", "call"), [({"denied": frozenset({"orders"})}, {"select": ["customer_orders"]}), ({"denied": frozenset({"orders"})}, {"select": ["events"], "where": [{"entity": "customer", "having": {"id": "customer_orders", "value": 1}, "over": "all_time"}]}), ({"withheld": {"orders": 5}}, {"select": ["customer_orders"]}), ({"constraints": {"orders": {"required_group_by": ["order.status"]}}}, {"select": ["customer_orders"]})])
def test_a_lookup_opens_no_closed_measure(spark, rule, call):
    refused("POLICY_DENIED", lambda: Engine(spark, replace(PACKAGE, **rule), parquet_folder(spark, SF, DERIVED)).query(call))


def joined(spark):
    tables = {
        "people": spark.createDataFrame([(1,), (2,), (3,)], "id long"),
        "visits": spark.createDataFrame([(1, 5.0), (1, 1.0), (None, 2.0)], "person long, cost double"),
        "calls": spark.createDataFrame([(2, None), (3, 4.0), (None, 9.0)], "person long, cost double"),
    }
    package = Package(
        entities={"person": Entity("people", ("id",)), "visit": Entity("visits"), "call": Entity("calls")},
        relationships=(Relationship("visit", "person", (("person", "id"),)), Relationship("call", "person", (("person", "id"),))),
        dimensions={"person.id": Dimension("person", "id"), "visit.person": Dimension("visit", "person"), "call.person": Dimension("call", "person")},
        measures={"visits": Measure("visit", "1", "count"), "visit_cost": Measure("visit", "cost"), "calls": Measure("call", "1", "count"), "call_cost": Measure("call", "cost"), "mean": Measure("call", "cost", "avg")},
    )
    return Engine(spark, package, tables)


def test_parts_are_settled_over_all_keys(spark):
    call = {"parts": [{"select": ["visits", "visit_cost"], "group_by": ["visit.person"]}, {"select": ["calls", "call_cost", "mean"], "group_by": ["call.person"]}], "join": [["visit.person"], ["call.person"]]}
    got = joined(spark).query(call)
    row = lambda r: (r.key0, r.in0, r.visits, r.visit_cost, r.in1, r.calls, r.call_cost, r["mean"])
    assert sorted(map(row, got.collect()), key=repr) == sorted(
        [
            (1, True, 2, 6.0, False, 0, 0.0, None),  # no calls: 0, and no mean
            (2, False, 0, 0.0, True, 1, None, None),  # a call of unknown cost stays unknown
            (3, False, 0, 0.0, True, 1, 4.0, 4.0),
            (None, True, 1, 2.0, False, None, None, None),  # unknown keys meet nothing
            (None, False, None, None, True, 1, 9.0, 9.0),
        ],
        key=repr,
    )
    both = joined(spark).query({**call, "keep": [0, 1]})
    assert both.where("key0 is not null").count() == 0
    assert {r.key0 for r in joined(spark).query({**call, "keep": [1]}).collect()} == {2, 3, None}


def test_first_and_last_of_one_instant_are_defined(spark):
    at = datetime(2024, 1, 1)
    for rows in ([(at, 1.0), (at, 3.0), (at, None)], [(at, None), (at, 3.0), (at, 1.0)]):
        package = Package(entities={"t": Entity("t")}, clocks={"at": Clock("t", "at")}, measures={"v": Measure("t", "v", clock="at")})
        got = Engine(spark, package, {"t": spark.createDataFrame(rows, "at timestamp_ntz, v double")}).query({"select": [{"id": "v", "as": "a", "agg": "first_value"}, {"id": "v", "as": "b", "agg": "last_value"}]})
        assert tuple(got.first()) == (1.0, 3.0)


def test_observation_scope(spark):
    call = {"select": ["orders"], "where": [{"id": "order.status", "value": "none of them"}]}
    assert engine(spark, SF).query(call).first()["orders"] == 0


def test_pipeline_steps(spark):
    tables = {
        "a": spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string"),
        "b": spark.createDataFrame([(1, "p"), (1, "q")], "id long, name string"),
        "states": spark.createDataFrame([(1, "on", date(2024, 1, 1), date(2024, 1, 2)), (2, "off", date(2024, 1, 1), None)], "id long, state string, since date, until date"),
        "days": spark.createDataFrame([(1, date(2024, 1, 1)), (1, date(2024, 1, 2)), (2, date(2024, 1, 2))], "id long, day date"),
    }
    run = lambda *steps: sorted(tuple(r) for r in run_pipeline(spark, tables.__getitem__, list(steps)).collect())
    both = lambda x, y: {"union_all": {"branches": [{"relation": "a", "columns": x}, {"relation": "b", "columns": y}]}}
    assert len(run(both(["id", "name"], ["id", "name"]))) == 4
    refused("INVALID_CONFIG", lambda: run(both(["id", "name"], ["name", "id"])))
    join = {"join": {"relation": "b", "on": [{"left": "id"}], "type": "left", "select": {"id": "left.id", "name": "left.name", "other": "right.name"}}}
    assert run({"source": {"relation": "a"}}, join) == [(1, "x", "p"), (1, "x", "q"), (2, "y", None)]
    assert {r[:2] for r in run({"source": {"relation": "a"}}, {"join": {**join["join"], "type": "inner"}})} == {(1, "x")}
    refused("INVALID_CONFIG", lambda: run({"source": {"relation": "a"}}, {"join": {**join["join"], "require_pre_aggregate": True}}))
    refused("INVALID_CONFIG", lambda: run({"source": {"relation": "a"}}, {"group_by": {"dimensions": ["name"], "aggregates": {"id": {"fn": "max", "expr": "id"}}}}, join))
    state = {"state_as_of": {"relation": "states", "spine": "day", "valid_from": "since", "valid_to": "until", "columns": ["state"], "on": [{"left": "id"}]}}
    assert run({"source": {"relation": "days"}}, state) == [(date(2024, 1, 1), 1, "on"), (date(2024, 1, 2), 2, "off")]


@pytest.mark.parametrize("kind", ["aggregate", "scoped_aggregate"])
def test_inline_reads_are_governed(spark, kind):
    ask = lambda **rules: Engine(spark, replace(PACKAGE, **rules), parquet_folder(spark, SF, DERIVED)).query({"select": [{"as": "x", "expr": {"kind": kind, "id": "revenue", "agg": "max"}}]})
    assert ask().count() == 1
    refused("POLICY_DENIED", lambda: ask(denied=frozenset({"revenue"})))
    refused("POLICY_DENIED", lambda: ask(withheld={"revenue": 3}))
    refused("POLICY_DENIED", lambda: ask(constraints={"revenue": {"required_group_by": ["customer.segment"]}}))


def test_windows_and_stocks_that_are_refused(spark):
    ask = lambda e, **call: engine(spark, SF).query({"select": [{"as": "x", "expr": e}], **call})
    refused("INVALID_QUERY", lambda: ask({**LOOK_BACK["expr"], "partition_by": ["event.type"]}, time={"grain": "month"}))
    refused("INVALID_EXPRESSION_AST", lambda: ask({"kind": "semi_additive", "id": "revenue"}))
    refused("ROLLUP_UNSAFE", lambda: ask({"kind": "cumulative", "input": {"kind": "aggregate", "id": "revenue", "agg": "avg"}}, time={"grain": "month"}))
