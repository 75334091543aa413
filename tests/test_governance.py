"""Rules on what may be asked, what an answer says, the catalog, and expressions as text."""

from dataclasses import replace

import pytest

from millrace.catalogue import DERIVED, FORWARD, PACKAGE, engine
from millrace.errors import SemanticError
from millrace.functions.infix import parse
from millrace.functions.words import check_strings, condition
from millrace.plans.answer import answer, fetch
from millrace.plans.catalog import catalog, discover, offers
from millrace.plans.engine import Engine
from millrace.plans.governance import visible
from millrace.sources.relations import parquet_folder

SF = "/root/testdata/sf0.001"
ROLLING = {"as": "x", "expr": {"kind": "rolling", "input": {"kind": "measure", "id": "orders"}, "unit": "month", "value": 2}}


def over(spark, package):
    return Engine(spark, package, parquet_folder(spark, SF, DERIVED))


def refused(code, run):
    with pytest.raises(SemanticError) as e:
        run()
    assert e.value.code == code


@pytest.mark.parametrize(
    ("rule", "call", "ok"),
    [
        ({"allowed_group_by": ["order.status"]}, {"group_by": ["order.status"]}, True),
        ({"allowed_group_by": ["order.status"]}, {"group_by": ["order.priority"]}, False),
        ({"required_group_by": ["order.status"]}, {}, False),
        ({"allowed_where": []}, {"where": [{"id": "order.status", "value": "F"}]}, False),
        ({"required_where": [{"id": "order.status", "value": "F"}]}, {"where": [{"id": "order.status", "value": "F"}]}, True),
        ({"required_where": [{"id": "order.status", "value": "F"}]}, {"where": [{"id": "order.status", "word": "not", "value": "F"}]}, False),
        ({"allowed_clocks": []}, {"time": {"grain": "year"}}, False),
        ({"allow_metric_filters": False}, {"having": [{"id": "aov", "word": "gt", "value": 1}]}, False),
        ({"allow_metric_filters": False}, {"where": [{"id": "order.status", "value": "F"}]}, True),
    ],
)
def test_constraints_bind_all_that_reads_a_measure(spark, rule, call, ok):
    e = over(spark, replace(PACKAGE, constraints={"revenue": rule}))
    run = lambda: e.query({"select": ["aov"], **call})
    run() if ok else refused("POLICY_DENIED", run)
    over(spark, PACKAGE).query({"select": ["orders"], **{k: v for k, v in call.items() if k != "having"}})


def test_hidden_objects_do_not_exist(spark):
    seen = visible(PACKAGE, {"revenue"})
    assert "aov" not in seen.metrics and "urgent_share" in seen.metrics
    refused("OBJECT_NOT_FOUND", lambda: over(spark, seen).query({"select": ["aov"]}))


def test_names_can_not_be_borrowed(spark):
    refused("OUTPUT_NAME_GOVERNED", lambda: engine(spark, SF).query({"select": [{"id": "orders", "as": "revenue"}]}))


def test_names_stay_apart_by_key(spark):
    keyed = replace(PACKAGE, dimensions=PACKAGE.dimensions | {"customer.segment": replace(PACKAGE.dimensions["customer.segment"], key="customer.key")})
    got = over(spark, keyed).query({"select": ["orders"], "group_by": ["customer.segment"]})
    assert got.columns == ["customer.segment", "customer.key", "orders"]
    assert got.count() == engine(spark, SF).query({"select": ["orders"], "group_by": ["customer.key"]}).count()


@pytest.mark.parametrize(
    ("call", "codes"),
    [
        ({"select": ["orders"], "time": {"start": "1996-01-01", "end": "1996-02-01"}}, {"WINDOW_TOTAL"}),
        ({"select": ["orders"], "time": {"grain": "month", "this": "year", "now": "1996-03-05"}}, {"PARTIAL_PERIOD"}),
        ({"select": ["orders"], "time": {"grain": "month"}}, {"OBSERVED_PERIODS_ONLY"}),
        ({"select": [ROLLING], "time": {"grain": "month"}}, set()),
        ({"select": [{"id": "revenue", "agg": "max"}]}, {"AGGREGATION_OVERRIDE"}),
        ({"select": ["orders"], "group_by": ["part.brand"]}, {"REWRITE_APPLIED"}),
        ({"select": ["orders"], "where": [{"id": "order.status", "word": "not", "value": "F"}]}, {"UNKNOWN_ROWS_KEPT"}),
        ({"select": ["orders"], "where": [{"entity": "customer", "having": {"id": "orders", "value": 2}, "over": "all_time"}]}, {"ENTITY_FILTER_OVER"}),
    ],
)
def test_answers_say_how_they_were_read(spark, call, codes):
    assert answer(engine(spark, SF), call).codes() == codes


def test_fetch_caps_rows_and_tells_ties(spark):
    e = engine(spark, SF)
    refused("ROW_LIMIT", lambda: fetch(e, {"select": ["orders"], "group_by": ["customer.key"]}, max_rows=5))
    rows, notes = fetch(e, {"select": ["orders"], "group_by": ["order.price"], "order_by": [{"id": "orders", "desc": True}], "limit": 3})
    assert len(rows) == 3 and "TIES_AT_LIMIT" in {n["code"] for n in notes}
    rows, notes = fetch(e, {"select": ["orders"], "group_by": ["order.status"], "time": {"start": "2050-01-01", "end": "2051-01-01"}})
    assert rows == [] and "EMPTY_RESULT_WINDOW" in {n["code"] for n in notes}


def test_fetch_stops_a_slow_call(spark):
    slow = lambda name: parquet_folder(spark, SF, DERIVED)(name).withColumnRenamed("x", "x").where("cast(java_method('java.lang.Thread', 'sleep', cast(20 as bigint)) as string) is null")
    refused("QUERY_TIMEOUT", lambda: fetch(Engine(spark, PACKAGE, slow), {"select": ["orders"], "group_by": ["order.status"]}, timeout=0.5))


def test_catalog_and_search(spark):
    assert catalog(spark, replace(PACKAGE, denied=frozenset({"revenue"}))).where("id = 'revenue'").count() == 0
    assert discover(PACKAGE, "customer segments")[0] == ("dimension", "customer.segment")
    assert discover(PACKAGE, "zebra") == []
    assert "nation.name" in offers(PACKAGE, "revenue")["group_by"] and "part.brand" not in offers(PACKAGE, "revenue")["group_by"]


def test_text_expressions():
    name = lambda n: {"kind": "measure", "id": n}
    assert parse("-(a + b.c) * 2 > 3", name)["word"] == "gt"
    assert parse("a not in [1, 2]", name) == {"kind": "comparison", "word": "not", "args": [name("a"), [1, 2]]}
    for bad in ("a; b", "f(a)", "a < b < c", "lambda: 1", "a in b", "a ** 2", "a if b else c", "+" * 300 + "a"):
        refused("INVALID_EXPRESSION_AST", lambda bad=bad: parse(bad, name))


def test_text_that_is_not_text(spark):
    for bad in ("a\0", "\ud800"):
        refused("INVALID_QUERY", lambda bad=bad: check_strings({"where": [{"value": bad}]}))
    refused("INVALID_QUERY", lambda: condition(spark.range(1).id, "contains", "Straße"))


@pytest.mark.parametrize(
    ("code", "call"),
    [
        ("MIXED_GRAIN_INVALID", {"select": ["events"], "group_by": ["order.status"], "time": {"grain": "month"}}),
        ("MIXED_GRAIN_INVALID", {"select": [{"id": "event_value", "agg": "max"}], "group_by": ["order.status"]}),
        ("CONVERSION_MATCHING_MODE_REQUIRED", {"select": [{"as": "x", "expr": {"kind": "conversion", "base": {"id": "events"}, "converted": {"id": "events"}, "entity": "event.user", "window": {"unit": "day", "value": 1}}}]}),
        ("PREDICATE_GRAIN_UNSAFE", {"select": ["orders"], "where": [{"entity": "customer", "having": {"id": "orders", "value": 2}, "over": "period"}]}),
    ],
)
def test_refusals_of_crossing_calls(spark, code, call):
    refused(code, lambda: engine(spark, SF).query(call))


def test_a_parent_is_read_from_its_children_only_without_time(spark):
    refused("MIXED_GRAIN_INVALID", lambda: over(spark, FORWARD).query({"select": [{"id": "balance", "agg": "median"}], "group_by": ["order.status"]}))
