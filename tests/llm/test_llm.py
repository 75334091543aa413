"""Operators against brute force, round trips and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, kernels, langid, packing, perplexity, queries, substring, templates, topk, urlfilter
from millrace.llm.components import components
from millrace.llm.jaccard import jaccard_components
from millrace.llm.revisits import resolve_revisits

ODD = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, "one", "en"), (4, "one", "en"), (None, "without an id at all", "de"), (5, "word " * 30_000, "en"), (6, "éİ 中文 ퟿", "fr")]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    rows, out = [words(rng, 120) for _ in range(12)], []
    for i, text in enumerate(rows):
        out.append(text)
        for k in range(i):  # copies with a growing number of edits
            w = text.split()
            for j in rng.sample(range(len(w)), k % 6):
                w[j] = words(rng, 1)
            out.append(" ".join(w))
    return [(i, t, "en") for i, t in enumerate(out)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "unit": F.lit("x"), "kind": F.lit(2)})


def brute_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    at = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
    return {i: (len(s), at[i]) for i, s in sets.items()}


def test_jaccard(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, docs)).collect()}
    assert got == brute_components(docs)
    odd = sorted(map(tuple, jaccard_components(frame(spark, ODD)).collect()), key=repr)
    assert len(odd) == len(ODD) and (1, 0, 1) in odd and odd.count((4, 1, 4)) == 2 and (None, 1, None) in odd
    assert jaccard_components(frame(spark, ODD).limit(0)).count() == 0


def test_substring(spark, docs):
    passage = words(random.Random(9), 60)
    rows = [(i, f"{t[:300]} {passage} {t[300:]}" if i % 9 == 0 else t, "en") for i, t, _ in docs[::9]]
    got = substring.dedup_substrings(frame(spark, [(1000 + i, words(random.Random(i), 50) + " " + passage, "en") for i in range(5)] + rows)).collect()
    cut = {r.doc_id: r.removed for r in got}
    assert sum(bool(v) for v in cut.values()) >= 4 and all(not s or s[0].first_doc_id is not None for s in cut.values())
    odd = substring.dedup_substrings(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and {r.doc_id: r.text for r in odd}[1] is None
    text = words(random.Random(1), 400).encode()
    a, b = (substring.boundaries(np.frombuffer(x, np.uint8)) for x in (text, b"inserted " + text))
    assert len(set((b - 9).tolist()) & set(a.tolist())) > 0.8 * len(a) and a[-1] == len(text)


def test_topk(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(120)] + [(0, [1.0] * 4), (50, None), (100, [1.0, None, 1.0, 1.0]), (150, [float("nan")] * 4), (200, [1e30] * 4), (250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, block_rows=16).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    good = [(j, i, [int(np.floor(256 * x)) for x in v]) for j, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for j, q, a in good:
        if q % 50 == 0:
            found = sorted((-min(max(sum(x * y for x, y in zip(a, b)), topk.LOW), topk.HIGH), i) for k, i, b in good if k != j and len(a) == len(b))[:5]
            want.setdefault(q, []).extend((-s, i) for s, i in found)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x", "http://example.net/de/", "https://x.org/fr/1?y", "http://net/", "http://net", "nothing", None, "ftp://example.com/de/a#b", "http://notexample.com/de/", "http://a.b.com/de"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.filter_urls(df, queries.RULES).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow", "allow"]
    assert got == urlfilter.filter_urls(df, queries.RULES, max_index_bytes=1).orderBy("page_id").collect()
    index = urlfilter.DigestArray(urlfilter.DigestArray.pack([b"a", b"b"], [1]))
    index.keys  # noqa: B018
    assert index.find([b"a", b"c"]).tolist() == [True, False]


def test_language(spark):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(12))
    rows = [(i, make("abcdef" if i % 2 else "uvwxyz"), "aa" if i % 2 else "uu") for i in range(80)]
    got = langid.identify(frame(spark, rows + ODD[:3]), F.col("doc_id") % 4 != 2).collect()
    named = {r[0]: r.lang_pred for r in got}
    assert all(named[i] == lang for i, _, lang in rows if i > 5) and {r.score for r in got if r.lang_pred == "und"} == {0.0}
    for n in (1, 2, 3, 5, 9):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code.tolist()}) == n
    assert {r.lang_pred for r in langid.identify(frame(spark, ODD).withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()} == {"und"}


def test_packing(spark):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    rows = ODD + [(10 + i, words(random.Random(i), i), "en") for i in range(40)]
    got = packing.pack_documents(frame(spark, rows), path, capacity=256).toPandas()
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 256 and (g.offset == g.length.cumsum() - g.length).all()
    sizes = got.groupby("doc_id").length.sum()
    assert all(sizes[i] == len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, _ in rows if i is not None and i != 4)
    from millrace.llm.wordbpe import WordBpe

    bpe = WordBpe(path)
    assert bpe.check_closed() == []
    for t in ["", "Don't!! we'll 12½ x__y \x1c \x85 <|endoftext|> Σίσ", "aé İstanbul Ǆ"]:
        assert np.frombuffer(bpe.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    counts = np.array([5, 3, 9, 1])
    used = np.zeros(4, int)
    for pattern, n in packing.plan(np.array([100, 60, 40, 256]), counts, 256):
        assert sum(k * v for k, v in pattern.items()) <= 256
        for k, v in pattern.items():
            used[[100, 60, 40, 256].index(k)] += v * n
    assert (used == counts).all()


def test_lines(spark):
    rows = [(i, f"common line of all pages\nviews {i} times on this site today\nonly {words(random.Random(i), 6)}\n\nend", "en") for i in range(8)] + ODD
    found = templates.dedup_lines(frame(spark, rows)).collect()
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    assert got[0].text == rows[0][1] and got[0].n_dropped == 0
    three = next(r for r in found if r.doc_id == 3 and r.n_lines == 5)
    assert three.text.startswith("only") and three.n_dropped == 3
    assert got[7].text.startswith("only") and got[7].n_dropped == 3 and got[7].n_lines == 5
    assert templates.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(4)
    items = [(i, words(rng, 30)) for i in range(20)] + [(98, None), (99, ""), (97, "zq")]
    docs, want = [], set()
    for i in range(60):
        text = words(rng, 100)
        if i % 3 == 0:
            item = list(items[i % 20][1].upper())
            for _ in range(i % 9):
                item[rng.randrange(len(item))] = "x"
            text = text[:200] + "!! " + "".join(item) + ",  " + text[200:]
            want.add((i, i % 20))
        docs.append((i, text, "en"))
    found = decontaminate.find_leaks(frame(spark, docs + [(80, "a zq b", "en")] + ODD), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(80, 97)}
    assert all(r.edits <= 18 for r in found)


def test_quality(spark, docs):
    rng = random.Random(8)
    rows = [(1000 + i, "".join(rng.choices("!$%&*XYZ ", k=400)), "en") for i in range(5)] + [(i, t, lang) for i, t, lang in docs] + ODD[:3]
    trusted = spark.createDataFrame([(i,) for i, _, _ in docs[::2]], "doc_id long")
    got = {r.doc_id: r for r in perplexity.classify(frame(spark, rows), trusted).collect()}
    assert not any(got[1000 + i].keep for i in range(5)) and sum(got[i].keep for i, _, _ in docs[4:]) >= len(docs) - 6
    assert got[1001].perplexity > 4 * got[40].perplexity


def test_quality_threshold_is_a_quantile_of_held_out_texts(spark):
    rows = [(i, words(random.Random(100 + i), 60), "en" if i % 2 else "de") for i in range(120)]
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    scored = {r.doc_id: r for r in perplexity.score(frame(spark, rows), trusted).collect()}
    out = {i for i, r in scored.items() if r.held_out}
    assert 10 <= len(out) <= 35 and out < set(range(100)) and all(scored[i].trusted for i in range(100))
    mean = lambda ids: sum(scored[i].perplexity for i in ids) / len(ids)
    assert mean(out) > 1.02 * mean(set(range(100)) - out)  # the model has not seen them
    for r in perplexity.classify(frame(spark, rows), trusted).collect():
        same = [scored[i].perplexity for i in out if scored[i].lang == r.lang]
        assert abs(r.threshold - max(same)) < 1e-9 and r.keep == (r.perplexity <= r.threshold)
    one = spark.createDataFrame([(5,)], "doc_id long")
    got = {r.doc_id: r for r in perplexity.classify(frame(spark, rows), one).collect()}
    assert {r.threshold for r in got.values()} == {got[5].perplexity}


def test_revisits(spark):
    h = {"Date": "1"}
    rows = [
        (1, "http://www.a.com/x/?utm_id=1", 1, 200, "e1", None, "d1", {"date": "1", "server": "s"}), (2, "https://a.com/x#f", 5, 304, "e1", None, None, {"Date": "5", "Server": "t"}), (3, "https://a.com/x", 6, 304, "e2", None, None, h),
        (4, "https://a.com/x", 7, 304, None, None, None, h), (5, "https://b.com/", 1, 304, "e1", None, None, h), (6, "https://a.com/x", 7, 200, "e3", "l", "d3", h), (7, "https://a.com/x", 99, 304, "e3", None, None, None), (8, None, 1, 200, None, None, None, None), (9, "https://a.com/x", 9, 404, None, None, None, h),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string, payload_digest string, headers map<string,string>")
    for slice_rows in (1, 5000):
        got = {r.record_id: r for r in resolve_revisits(df, slice_rows=slice_rows).collect()}
        assert [got[i].outcome for i in range(1, 10)] == ["full", "resolved", "mismatch", "no_validator", "missing", "full", "resolved", "other", "other"]
        assert got[2].refers_to == 1 and got[2].headers == {"server": "s", "Date": "5"} and got[7].payload_digest == "d3"


def test_components(spark):
    edges = [(i, i + 1) for i in range(30) if i % 10 != 9] + [(5, 5), (None, 3), (40, 41), (41, 42), (42, 40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {}
    for r in components(df).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(0, 10)), list(range(10, 20)), list(range(20, 30)), [40, 41, 42]]


def test_shingles_ignore_case_and_spaces():
    a, b, c = kernels.shingles([b"A b c d e f", b"a  B\tc d e\nf", b"x"])
    assert np.array_equal(a, b) and len(a) == 2 and len(c) == 1


def test_pipeline(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leaks = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    assert len(packed) and not leaks & set(packed.doc_id) and packed.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, leak = (words(rng, 40) for _ in range(4))
    near = frame(spark, [(3, a, "en"), (None, a, "en"), (2, a, "en"), (2, a, "en"), (2, b, "en"), (None, c, "en"), (None, c, "en"), (None, "", "en")])
    got = corpus_pipeline.near_copy_stage(spark, near, "")
    assert got.columns == near.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(2, a), (2, b), (None, c), (None, "")], key=repr)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(None, f"{b} {leak}", "en"), (None, c, "en"), (7, f"{leak} {b}", "en"), (7, a, "en"), (8, b, "en")])
    got = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, c), (7, a), (8, b)], key=repr)
