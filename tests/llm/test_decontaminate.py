"""The banded search against plain edit distances."""

import random
import time

import numpy as np
import pytest

from millrace.llm import decontaminate
from millrace.llm.decontaminate import Items, find_leaks, fold


def nearest(item: bytes, raw: bytes) -> int:
    """Least edits between the item and any part of the text."""
    row = [0] * (len(raw) + 1)
    for x in item:
        new = [row[0] + 1]
        for j, y in enumerate(raw):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edits(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def edited(rng, text: str, k: int) -> str:
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            out.insert(at, rng.choice("xyz"))
        else:
            del out[at]
    return "".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_search_is_that_of_edit_distances(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(1, 6)))
    words = lambda n: " ".join(word() for _ in range(n))
    texts = [fold(words(rng.randint(3, 30)).encode()) for _ in range(12)] + [b"ab" * 40, b"aaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    items = Items(list(enumerate(texts)), 0.1)
    for _ in range(25):
        i = rng.randrange(len(texts))
        held = edited(rng, texts[i].decode(), rng.randint(0, int(items.budget[i]) + 2))
        where = rng.randrange(4)
        raw = fold(f"{words(6) if where & 1 else ''}{held}{words(6) if where & 2 else ''}".encode())
        got = items.search(raw)
        want = {j: d for j, t in enumerate(texts) if (d := nearest(t, raw)) <= items.budget[j]}
        assert {j: e for j, (e, _, _) in got.items()} == want
        for j, (e, a, b) in got.items():
            assert edits(texts[j], raw[a:b]) == e


def test_hits_are_counted_in_slices(monkeypatch):
    rng = random.Random(5)
    texts = [b"ab" * 30 + bytes(rng.choices(b"abcd", k=30)) for _ in range(10)]
    raw = b"ab" * 200 + texts[3] + b"ba" * 100
    whole = Items(list(enumerate(texts)), 0.1)
    want = whole.search(raw), sorted(whole.candidates(raw))
    monkeypatch.setattr(decontaminate, "HITS", 500)
    assert (whole.search(raw), sorted(whole.candidates(raw))) == want and want[0][3][0] == 0


def test_long_items_cost_a_band_only():
    rng = random.Random(6)
    item = "".join(rng.choices("abcdefghij ", k=16_000))
    texts = [fold(item.encode())]
    items = Items([(0, texts[0])], 0.1)
    raw = fold(edited(rng, "".join(rng.choices("abcdefghij ", k=30_000)) + item, 0).encode())
    near = fold(("".join(rng.choices("abcdefghij ", k=5_000)) + edited(rng, item, 300)).encode())
    began = time.process_time()
    assert items.search(raw)[0][0] == 0 and 200 < items.search(near)[0][0] <= 300
    assert time.process_time() - began < 60


def test_shards_find_what_one_does(spark):
    rng = random.Random(7)
    items = [(i, " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20))) for i in range(12)] + [(None, "a null id holds a text too"), (3, None), (3, ""), (1, "x")]
    docs = [(i, f"begin {items[i % 12][1]} end") for i in range(30)] + [(None, items[0][1]), (50, None), (51, ""), (52, "y x z"), (53, "x " * 20_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS start")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    one = sorted(map(tuple, find_leaks(frame, bench).collect()), key=repr)
    many = sorted(map(tuple, find_leaks(frame, bench, max_index_bytes=300).collect()), key=repr)
    assert one == many and len(one) == 33 and (52, 1, 2, 1, 0) in one
    assert find_leaks(frame.limit(0), bench).count() == 0 and find_leaks(frame, bench.limit(0)).count() == 0


def test_items_of_one_gram_many_times():
    items = Items([(0, b"a" * 400)], 0.1)
    assert items.search(b"b" * 50 + b"a" * 2000)[0][0] == 0 and not items.search(b"b" * 2000)
    assert np.all(items.budget == 40)
