"""Language ID, substring dedup and packing against plain loops."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import langid, packing, queries, substring

SCHEMA = "doc_id long, text string, lang string"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=5)) for _ in range(n))


def folded(text):
    kept = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    return b"    " + b" ".join(kept.split()) + b" "


def buckets(text):
    """Every n-gram's bucket: the n last bytes as a number, first byte highest in age, hashed to 16 bits."""
    t = folded(text)
    for at in range(4, len(t)):
        for n in langid.ORDERS:
            value = sum(t[at - k] << (8 * k) for k in range(n))
            hashed = ((value * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) * 0xC2B2AE35 & 0xFFFFFFFF
            yield hashed >> 16


def plain_languages(learn, texts):
    """A decoder in loops: per bit the log of the mean shares of the two classes, per text the language of least weighted loss."""
    counts = {}
    for text, lang in learn:
        counts.setdefault(lang, Counter()).update(buckets(text))
    langs = sorted(counts)
    code = langid.codewords(len(langs))
    size = langid.BUCKETS
    share = {x: [(counts[x][b] + 0.05) / (sum(counts[x].values()) + 0.05 * size) for b in range(size)] for x in langs}
    weights, worth = [], []
    for bit in range(code.shape[1]):
        one, zero = ([x for x, c in zip(langs, code[:, bit]) if c == sign] for sign in (1, -1))
        p, q = ([sum(share[x][b] for x in side) / len(side) for b in range(size)] for side in (one, zero))
        weights.append([math.log(a / b) for a, b in zip(p, q)])
        worth.append(sum(0.5 * (a - b) * math.log(a / b) for a, b in zip(p, q)))
    worth = [w * len(worth) / sum(worth) for w in worth]
    out = []
    for text in texts:
        found = list(buckets(text))
        margins = [sum(w[b] for b in found) / len(langid.ORDERS) for w in weights]
        loss = [sum(v * float(np.logaddexp(0, -m * c)) for m, c, v in zip(margins, row, worth)) for row in code.tolist()]
        out.append((langs[loss.index(min(loss))], 1 / sum(math.exp(min(loss) - x) for x in loss)))
    return out


def test_language_decoding(spark):
    rng = random.Random(5)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklabcd", "dd": "äöüéabef"}
    rows = [(i, words(rng, 4, letters[x]) + rng.choice(["", " 12, X!", "\n"]), x) for i, x in enumerate(sorted(letters) * 10)]
    long = " ".join(t for _, t, _ in rows) * 3
    rows += [(100, long, None), (101, "e", None), (102, "ab éf", None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = dict(zip([i for i, _, _ in rows], plain_languages([(t, x) for i, t, x in rows if i < 30], [t for _, t, _ in rows])))
    for chunk in (langid._CHUNK, 64):  # a long text is read in pieces
        model = langid.train(frame.where("doc_id < 30"))
        run = langid._predict(type("Model", (), {"value": model}), 0.6)
        before, langid._CHUNK = langid._CHUNK, chunk
        try:
            got = {r["doc_id"]: r for b in run(iter(frame.select("doc_id", "text").toArrow().to_batches())) for r in b.to_pylist()}
        finally:
            langid._CHUNK = before
        for i, (lang, score) in want.items():
            assert abs(got[i]["score"] - score) < 1e-3 and (got[i]["lang_pred"] == lang or score < 0.51), i
    spread = {r.doc_id: r for r in langid.identify(frame, F.col("doc_id") < 30).collect()}
    assert all(spread[i].lang_pred == got[i]["lang_pred"] and abs(spread[i].score - got[i]["score"]) < 1e-3 for i in want)


def test_language_id_holds_slices_of_a_batch():
    rng = random.Random(8)
    texts = [words(rng, 800, "abcdefgh" if i % 2 else "efghijkl") for i in range(1000)] + [None, "", "é " * 1_000_000]
    langs = ["aa" if i % 2 else "bb" for i in range(1000)]
    labelled, asked = pa.RecordBatch.from_pydict({"text": texts[:1000], "lang": langs}), pa.RecordBatch.from_pydict({"id": list(range(1003)), "text": texts})
    model = ["aa", "bb"], np.array([[1] * 7, [-1] * 7], np.int8), np.full((langid.BUCKETS, 7), 0.25, np.float32), np.ones(7)
    run = langid._predict(type("Model", (), {"value": model}), 0.6)
    for job in (lambda: langid._count(iter([labelled])), lambda: run(iter([asked.slice(0, 1002)]))):  # 5 MB of text; held: a slice
        tracemalloc.start()
        for _ in job():
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 9e6, peak
    for r in langid._count(iter([labelled])):  # every n-gram of the batch is counted
        mine = [t for t, x in zip(texts, langs) if x == r.column("lang")[0].as_py()]
        assert sum(r.column("n").to_pylist()) == len(langid.ORDERS) * sum(len(folded(t)) - 4 for t in mine)
    rows = lambda *batches: [x for r in run(iter(batches)) for x in zip(*(r.column(n).to_pylist() for n in ("id", "lang_pred", "score")), strict=True)]
    whole = rows(asked)
    assert [i for i, _, _ in whole] == list(range(1003)) and [whole[i] for i in (0, 999, 1000, 1001, 1002)] == rows(*(asked.slice(i, 1) for i in (0, 999, 1000, 1001, 1002)))


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = F.expr("crc32(cast(doc_id as string)) % 4 <> 2")
    known = docs.where("lang is not null and text rlike '[a-zA-Z]'").select("doc_id", F.col("lang").alias("said"))
    out = langid.identify(docs, learn, keep={"held_out": ~learn}).join(known, "doc_id").where("held_out").collect()
    assert len(out) >= 10 and sum(r.lang_pred == r.said for r in out) >= 0.95 * len(out)


def plain_chunks(text):
    """Ends of chunks by rolling one byte after another."""
    ends, last, h = [], 0, 0
    for i, b in enumerate(text):
        h = ((h << 1) + int(substring._GEAR[b])) & (2**64 - 1)
        size = i + 1 - last
        if size >= substring.LEAST and (h >> 40) % 2**substring.BITS == 0 or size == substring.MOST:
            ends.append(i + 1)
            last = i + 1
    return ends + [len(text)] * (last < len(text))


def test_substrings(spark):
    rng = random.Random(6)
    shared = [words(rng, rng.choice([10, 30, 80])) for _ in range(6)]
    rows = [(k * 7 % 60, "".join(rng.choice([words(rng, 20), rng.choice(shared), "ö" * 400, "-"]) + " " for _ in range(6)), None) for k in range(60)]
    rows += [(60, rows[3][1], None), (61, rows[3][1][:-20], None), (62, "", None), (63, None, None), (64, shared[0] * 40, None)]
    first, want = {}, {}
    for i, text, _ in sorted(rows):
        raw = (text or "").encode()
        begin, kept, run = 0, b"", b""
        for end in [*plain_chunks(raw), None]:
            chunk = raw[begin:end] if end else b""
            again = bool(end) and chunk in first
            if again:
                run += chunk
            else:
                kept += (run if len(run) < 120 else b"") + chunk
                run = b""
                first.setdefault(chunk, i)
            begin = end
        want[i] = None if text is None else kept.decode(errors="ignore")
    got = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    for i, text, _ in rows:
        cut = text and text.encode()
        assert all(s.length >= 120 and s.first_doc_id <= i for s in got[i].removed) and sum(s.length for s in got[i].removed) <= len(cut or b"")
    assert sum(bool(r.removed) for r in got.values()) > 20
    assert substring.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole = Tokenizer.from_file(path)
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(60)) + rng.choice(["", "\n\n", " don't 12½", " 中文é"]), None) for i in range(40)]
    rows += [(50, "", None), (51, None, None), (52, words(rng, 3000), None), (None, "no id", None), (53, "twice", None), (53, "twice", None)]
    want = []
    for i, text, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, a, len(ids[a : a + 128]), zlib.crc32(ids[a : a + 128].tobytes())) for k, a in enumerate(range(0, len(ids), 128))]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"piece": F.lit("x"), "length": F.lit(1.5)})
    got = packing.pack_documents(frame, path, capacity=128).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    least = math.ceil(sum(used.values()) / 128)
    assert max(used.values()) <= 128 and least <= len(used) <= math.ceil(1.1 * least)
    assert packing.pack_documents(frame.limit(0), path).count() == 0
