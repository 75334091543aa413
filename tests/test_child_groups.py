"""Groups on children: right on odd rows, and dealt to tasks by the size of the tables."""

import random
import re
from collections import defaultdict

import pytest

from millrace.catalogue import QUERIES
from millrace.plans import leaf
from millrace.plans.engine import Engine
from millrace.plans.model import Dimension, Entity, Measure, Package, Relationship

SF = "/root/testdata/sf0.001"
SHOP = Package(
    entities={"parent": Entity("parents", ("id",)), "child": Entity("children"), "kind": Entity("kinds", ("kind",))},
    relationships=(Relationship("child", "parent", (("parent", "id"),)), Relationship("child", "kind", (("kind", "kind"),))),
    dimensions={"child.flag": Dimension("child", "flag"), "child.size": Dimension("child", "size"), "kind.name": Dimension("kind", "name")},
    measures={"parents": Measure("parent", "id", "count"), "price": Measure("parent", "price")},
)


def dealt(spark, df):
    """The keys and numbers of tasks by which child rows are dealt."""
    plan = spark.sql("EXPLAIN SELECT * FROM {df}", df=df).first()[0]
    return re.findall(r"hashpartitioning\((__c\d.*?), (\d+)\)", plan)


@pytest.mark.parametrize("name", ["same_child_groups", "child_group_counts_once"])
def test_children_are_dealt_once_by_key_to_as_many_tasks_as_their_table_needs(spark, monkeypatch, name):
    tasks = {}
    for share in (10_000, 2_500):
        monkeypatch.setattr(leaf, "SHARE", share, raising=False)
        (keys, n), *more = dealt(spark, QUERIES[name](spark, SF))
        assert not more and "," not in keys  # no shuffle by the groups too, which gathers distinct rows before it
        tasks[share] = int(n)
    assert 8 < tasks[10_000] and 3 < tasks[2_500] / tasks[10_000] < 5


def test_tasks_go_by_what_a_table_is_read_from(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leaf, "SHARE", 1 << 16)
    spark.range(200_000).selectExpr("id", "hash(id) as x").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    n = leaf.shares(t)
    assert 10 < n < 100
    assert leaf.shares(t.groupBy("x").count()) == n
    assert leaf.shares(t.join(t.withColumnRenamed("x", "y"), "id")) in range(2 * n - 2, 2 * n + 1)  # not the product
    assert leaf.shares(spark.createDataFrame([(1,)], "id long")) == 8  # not known: the session's number
    assert leaf.shares(t.limit(0).unionByName(spark.createDataFrame([(1, 1)], "id long, x int"))) == 8
    monkeypatch.setattr(leaf, "MOST_TASKS", 5)
    assert leaf.shares(t) == 5


def test_groups_of_odd_children(spark, tmp_path):
    rnd = random.Random(5)
    parents = [(None, 3), (0, None), (7, 70), (7, 70), (7, 71), *((i, i * 10) for i in range(100, 400))]  # no key, a key twice and thrice
    children = [(None, "a", 1.0, 1), (0, None, 0.0, 1), (0, None, -0.0, 2), (7, "a", float("nan"), None), (7, "a", float("nan"), 2), (999, "z", 9.0, 1)]
    children += [(100, rnd.choice("ab"), float(rnd.randrange(40)), rnd.randrange(4)) for _ in range(5000)]  # one parent with most of the children
    children += [(rnd.randrange(100, 450), rnd.choice(["a", "b", None]), float(rnd.randrange(3)), rnd.choice([None, 1, 2, 3])) for _ in range(1000)]
    for name, rows, shape in (("parents", parents, "id long, price long"), ("children", children, "parent long, flag string, size double, kind long"), ("kinds", [(1, "x"), (2, "x"), (3, "y")], "kind long, name string")):
        spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / name))
    engine = Engine(spark, SHOP, lambda name: spark.read.parquet(str(tmp_path / name)))
    kinds = {1: "x", 2: "x", 3: "y"}
    nan = lambda v: "nan" if isinstance(v, float) and v != v else v
    for groups, of in ((["child.flag", "child.size"], lambda c: (c[1], nan(c[2]))), (["kind.name"], lambda c: (kinds.get(c[3]),))):
        seen = defaultdict(set)
        for c in children:
            seen[of(c)] |= {p for p in parents if p[0] is not None and p[0] == c[0]}
        want = {(*g, len(ps), sum(p[1] for p in ps if p[1] is not None) if any(p[1] is not None for p in ps) else None) for g, ps in seen.items() if ps}
        got = engine.query({"select": ["parents", "price"], "group_by": groups}).collect()
        assert len(got) == len(want)
        assert {tuple(map(nan, r)) for r in got} == want
