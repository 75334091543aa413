"""The byte model against a plain computation of interpolated modified Kneser-Ney."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import perplexity
from millrace.llm.roundtrip import Doc

SCHEMA = "doc_id long, text string, lang string"


def brute(texts, counted, order=perplexity.ORDER):
    """Perplexity per byte of every text, by the model of the counted ones."""
    padded = {i: b"\0" * (order - 1) + t.encode() for i, t in texts.items()}
    grams = lambda b: [b[k : k + order] for k in range(len(b) - order + 1)]
    counts = {order: Counter(g for i in counted for g in grams(padded[i]))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        n = [max(1, sum(v == j for v in c.values())) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        d = [0, *(min(max(0.05, j - (j + 1) * y * n[j] / n[j - 1]), j - 0.05) for j in (1, 2, 3))]
        total, freed = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            freed[g[:-1]] += d[min(v, 3)]
        tables[k] = c, d, total, freed

    def p(g):
        if not g:
            return 1 / 256
        c, d, total, freed = tables[len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        top = (c[g] - d[min(c[g], 3)]) / total[g[:-1]] if g in c else 0.0
        return top + freed[g[:-1]] / total[g[:-1]] * p(g[1:])

    return {i: math.exp(-sum(math.log(p(g)) for g in grams(b)) / len(grams(b))) if grams(b) else None for i, b in padded.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 5)))
    found = {i: " ".join(word() for _ in range(rng.randint(1, 60))) for i in range(60)}
    return found | {100: "", 101: "x", 102: "Zürich ≠ 中文\0end", 103: "ab " * 3000}


@pytest.mark.parametrize("block", [perplexity.BLOCK, 64])
def test_perplexity_is_that_of_a_plain_model(spark, texts, monkeypatch, block):
    if block == perplexity.BLOCK:
        got = {r.doc_id: r for r in perplexity.score(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], SCHEMA), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")).collect()}
        counted = [i for i in range(0, 60, 2) if not got[i].held_out]
        want = brute(texts, counted)
        assert 10 < len(counted) < 30 and len(got) == len(texts)
        for i, r in got.items():
            assert (r.perplexity is None) == (want[i] is None)
            assert want[i] is None or abs(r.perplexity / want[i] - 1) < 1e-5, i
        return
    docs = [Doc(i, t.encode(), None) for i, t in texts.items()]
    flags = [i % 2 == 0 for i in texts]
    whole = perplexity._asks(docs, flags)
    monkeypatch.setattr(perplexity, "BLOCK", block)  # texts are cut into many blocks
    parts = perplexity._asks(docs, flags)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    plain = Counter()
    for d in docs:
        b = b"\0" * 4 + d.text
        plain.update(int.from_bytes(b[k : k + 5], "big") for k in range(len(b) - 4))
    assert sorted(plain) == whole[0].tolist()
    value = np.arange(len(whole[0]), dtype=np.float32)
    rank = {g: k for k, g in enumerate(whole[0].tolist())}
    sums = perplexity._sums(docs, whole[0], value)
    for d, s in zip(docs, sums.tolist(), strict=True):
        b = b"\0" * 4 + d.text
        assert s == sum(rank[int.from_bytes(b[k : k + 5], "big")] for k in range(len(b) - 4))


def test_odd_rows(spark):
    """Nulls, repeats and other columns; nothing trusted, and no rows."""
    rows = [(1, None, "en"), (2, "", None), (3, "abc abc", None), (3, "abc abc", None), (None, "abc", "de")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS unit", "2 AS rng", "3 AS threshold", "'x' AS keep", "'y' AS __lang")
    none = spark.createDataFrame([], "doc_id long")
    got = perplexity.classify(docs, none).collect()
    assert len(got) == 5 and [r.keep for r in got if r.n] == [True] * 3 and {r.threshold for r in got} == {None}
    assert sorted(str(r.lang) for r in got) == ["de", "en", "und", "und", "und"]
    one = perplexity.classify(docs, spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")).collect()
    assert all(r.keep for r in one if r.doc_id == 3) and not any(r.keep for r in one if not r.n)
    assert perplexity.classify(docs.limit(0), none).count() == 0
