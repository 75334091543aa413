"""Top-k search, URL filters and revisit resolution on odd rows, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import revisits
from millrace.llm.revisits import resolve_revisits
from millrace.llm.topk import HIGH, LOW, exact_top_k
from millrace.llm.urlfilter import filter_urls

# -- top-k


@pytest.mark.parametrize("group_bytes", [1 << 27, 200])
def test_grid_of_tiles_and_shards(spark, group_bytes):
    rng = np.random.default_rng(2)
    rows = [(i % 170, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)]
    rows += [(400, [1e306, 1.0, 0.0]), (450, [-1e306] * 3), (500, [float("inf"), 0.0, 0.0]), (None, [1.0] * 3), (550, None), (600, [None, 1.0, 1.0]), (650, []), (50, [1e17, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).selectExpr("*", "1 AS block", "'x' AS score", "2 AS shard")
    found = exact_top_k(df, F.col("vec_id") % 50 == 0, block_rows=8, group_bytes=group_bytes).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    good = [(j, i, [int(np.floor(256 * x)) for x in v]) for j, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(256 * x) for x in v)]
    want: dict = {}
    for j, q, a in good:
        if q % 50 == 0:
            scored = sorted((-min(max(sum(x * y for x, y in zip(a, b, strict=True)), LOW), HIGH), i) for k, i, b in good if k != j and len(a) == len(b))[:5]
            want.setdefault(q, []).extend((n + 1, s, i) for n, (s, i) in enumerate(scored))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}
    assert 400 not in got and exact_top_k(df.limit(0), F.lit(True)).count() == 0


# -- URLs


def test_rules_in_many_arrays(spark):
    rng = random.Random(3)
    name = lambda n: "".join(rng.choices("ab", k=n))
    hosts = [".".join(name(1) for _ in range(rng.randint(1, 3))) for _ in range(30)]
    rules = [(rng.choice(hosts), "/" + name(rng.randint(0, 2)), rng.choice(["allow", "block"])) for _ in range(60)] + [("", "/x", "block"), ("a", "", "block")]
    urls = [f"http://{name(1)}.{rng.choice(hosts).upper()}/{name(3)}?{name(2)}" for _ in range(150)] + ["http://a", "http:///x/y", "://", "no url", None, "http://" + "a." * 5000 + "b/x", "http://a/" + "é" * 5000]
    df = spark.createDataFrame([(None if i == 7 else i % 140, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS verdict")
    last = {(h, p): v for h, p, v in rules}

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [((len(h) + len(p), len(h)), h + p, v) for (h, p), v in last.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    want = sorted(((None if i == 7 else i % 140, *judge(u)) for i, u in enumerate(urls)), key=repr)
    for most in (64 << 20, 400, 1):
        assert sorted(map(tuple, filter_urls(df, rules, max_index_bytes=most).collect()), key=repr) == want
    assert filter_urls(df, []).where("rule is not null or verdict != 'allow'").isEmpty()
    assert filter_urls(df.limit(0), rules).count() == 0


# -- revisits

CAPTURE = "record_id long, url string, ts long, status int, etag string, last_modified string, payload_digest string, headers map<string,string>"


def plain(rows):
    """Outcome and source of each row, one by one."""
    key = lambda f: tuple((x is not None, x) for x in (f[0], *f[4:7])) + ((f[7] is not None, sorted((f[7] or {}).items())),)
    out = []
    for r in rows:
        if r[1] is None or r[2] is None or r[3] not in (200, 304):
            out.append((r[0], "other", None))
        elif r[3] == 200:
            out.append((r[0], "full", None))
        else:
            before = [f for f in rows if f[3] == 200 and f[1] == r[1] and f[2] is not None and f[2] < r[2]]
            if not before:
                out.append((r[0], "missing", None))
                continue
            f = max(before, key=lambda f: (f[2], key(f)))
            both = [(a, b) for a, b in zip(r[4:6], f[4:6], strict=True) if a is not None and b is not None]
            kind = "no_validator" if not both else "mismatch" if any(a != b for a, b in both) else "resolved"
            out.append((r[0], kind, f[0] if kind == "resolved" else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("slice_rows", "fan"), [(5000, 1000), (3, 1000), (1, 2)])
def test_revisits_are_those_of_a_loop(spark, monkeypatch, slice_rows, fan):
    monkeypatch.setattr(revisits._carried, "__defaults__", (fan,))
    rng = random.Random(8)
    one = lambda *xs: rng.choice(xs)
    when = lambda: one(rng.randint(0, 40), rng.randint(0, 10**12), 500, None if rng.random() < 0.1 else 7)
    rows = []
    for i in range(260):
        status = one(200, 200, 304, 304, 304, 404, None)
        rows.append((one(i, i, i, None), one("a.com/x", "a.com/x", "b.com/", "c.com", None), when(), status, one("e1", "e2", None), one("l1", None), f"d{i}" if status == 200 else None, one({"date": str(i)}, None)))
    rows += rows[:20]
    df = spark.createDataFrame(rows, CAPTURE).selectExpr("*", "1 AS slice", "2 AS source", "3 AS full", "4 AS canonical2")
    got = resolve_revisits(df, slice_rows=slice_rows)
    assert sorted(((r.record_id, r.outcome, r.refers_to) for r in got.collect()), key=repr) == plain(rows)


def test_full_responses_without_an_id_are_sources(spark):
    rows = [(1, "a.com/x", 1, 200, "e", None, "d1", {}), (None, "a.com/x", 2, 200, "e", None, "d2", {}), (3, "a.com/x", 3, 304, "e", None, None, {})]
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, CAPTURE)).collect()}
    assert got[3].outcome == "resolved" and got[3].payload_digest == "d2" and got[3].refers_to is None
    assert resolve_revisits(spark.createDataFrame([], CAPTURE)).count() == 0
