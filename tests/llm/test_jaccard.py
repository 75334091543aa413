"""Blocks, regions and windows of the Jaccard join against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import jaccard
from millrace.llm.jaccard import jaccard_components

SCHEMA = "doc_id long, text string"


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_sets_within_the_threshold_share_a_block(percent):
    """The guarantee that regions rest on, for random pairs at and around the threshold, of all sizes."""
    rng, met, linked = np.random.default_rng(percent), 0, 0
    for trial in range(1500):
        n = int(rng.integers(1, 260))
        base = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
        a, b = (base[rng.random(len(base)) > rng.uniform(0, 0.3)] for _ in range(2))
        more = np.unique(rng.integers(1, 2**63, int(rng.integers(0, 1 + len(b) // 8)), dtype=np.uint64))
        b = np.union1d(b, more)
        if not len(a) or not len(b):
            continue
        both = len(np.intersect1d(a, b))
        known = {x: int(k) for x, k in zip(np.union1d(a, b).tolist(), rng.integers(0, 6, len(np.union1d(a, b))), strict=True)}
        common = set(np.intersect1d(a, b).tolist())
        kinds = lambda s: np.array([known[x] + 1 if x in common else known[x] for x in s.tolist()], np.uint8)  # noqa: E731, B023
        ka, kb = kinds(a), kinds(b)
        blocks = [jaccard._blocks(s[k > 0], k[k > 0], len(s), percent) for s, k in ((a, ka), (b, kb))]
        if 100 * both >= percent * (len(a) + len(b) - both):
            linked += 1
            met += len(np.intersect1d(*blocks)) > 0
    assert linked > 40 and met == linked


def clusters(seed, n_roots, near, edits):
    """Texts around some roots at growing distances, so that cells have boundaries."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    out = []
    for _ in range(n_roots):
        root = [word() for _ in range(rng.randint(20, 90))]
        for _ in range(near):
            w, k = root[:], rng.randint(0, edits)
            for _ in range(k):
                w[rng.randrange(len(w))] = word()
            cut = rng.randint(0, 3 * k)
            out.append(" ".join(w[cut:]))
    shared = [" ".join(word() for _ in range(9)) for _ in range(25)]
    out += [" ".join(rng.sample(shared, 8)) for _ in range(80)] + [" ".join(shared[:7] + [word()]) for _ in range(25)]
    return list(enumerate(out))


def test_components_are_those_of_all_pairs(spark):
    rows = clusters(4, 8, 16, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want
    assert 20 < len({c for _, c in want.values()}) < len(rows) - 40


def test_shared_sentences_are_not_compared(spark, monkeypatch):
    """Texts of sentences of one pool: pairs share shingles, few are near. Regions must not meet all pairs."""
    asked = []
    plain = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: asked.append(pairs.count()) or plain(pairs, *rest))
    rng = random.Random(7)
    pool = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(10)) for _ in range(40)]
    rows = [(i, " ".join(rng.sample(pool, 9))) for i in range(300)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and sum(asked) < 300
