"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is over bytes, of order 5, trained on trusted text. Units of documents send their distinct 5-grams, with counts in trusted
text, to shards; shards add them up, and the model's tables (continuation counts, context sums, discounts, probabilities of every gram that
occurs anywhere) are joins and sums over distinct grams. Probabilities return to the units by shard, which sum them per document. A text is
kept while its perplexity is within a quantile of trusted texts of its language that the model has not seen: one in HELD_OUT of the trusted
ids, by hash, stays out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix
from .roundtrip import NULL_ID, Doc, _squeeze, _unsqueeze, unit_of, units, unpack
from .shared import drop_staged, release, staged

ORDER = 5
#: One in so many trusted ids sets the thresholds and is not counted.
HELD_OUT = 5
#: Bytes of text whose grams are sorted at a time.
BLOCK = 256 << 10
U8 = np.dtype(np.uint64)


def _blocks(docs: list[Doc], pick: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grams of some documents, BLOCK bytes at a time, and the document of each: the gram that ends at each byte, after four zero bytes.

    A long text is cut, and its parts overlap by what a gram reaches back.
    """
    back = ORDER - 1
    held: list[tuple[int, bytes]] = []
    size = 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(part for _, part in held) + b"\0" * (8 - ORDER)
        n = len(raw) - 8 + 1
        found = np.ndarray((n,), ">u8", raw, 0, (1,)).astype(np.uint64) >> np.uint64(8 * (8 - ORDER))
        sizes = np.array([len(part) for _, part in held])
        owner = np.repeat(np.array([i for i, _ in held]), sizes)[back : back + n]
        ends = np.cumsum(sizes)[:-1]
        inside = np.ones(n, bool)  # a gram that begins in one part and ends in the next is none
        inside[(ends[:, None] - back + np.arange(back)).ravel()] = False
        return found[inside], owner[inside]

    for i in pick:
        text = b"\0" * back + (docs[i].text or b"")
        for a in range(0, len(text) - back, BLOCK):
            part = text[a : a + BLOCK + back]
            held.append((i, part))
            size += len(part)
            if size >= BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _runs(ascending: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(ascending[1:] != ascending[:-1]) + 1, [len(ascending)]]) if len(ascending) else np.zeros(1, np.int64)


def _asks(docs: list[Doc], trusted: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and their counts in trusted text. Only the distinct ones of each block are held."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for good in (True, False):
        for found, _ in _blocks(docs, [i for i, t in enumerate(trusted) if t is good]):
            found.sort()
            at = _runs(found)
            keys.append(found[at[:-1]])
            counts.append(np.diff(at) if good else np.zeros(len(at) - 1, np.int64))
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    at = _runs(flat)
    return flat[at[:-1]], np.add.reduceat(n[order], at[:-1]) if len(flat) else n


def _sums(docs: list[Doc], known: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Per document, the sum over its grams."""
    total = np.zeros(len(docs))
    for found, owner in _blocks(docs, range(len(docs))):
        lo = int(owner[0]) if len(owner) else 0
        both = found << np.uint64(24) | (owner - lo).astype(np.uint64)  # a gram has 40 bits, and a block fewer than 2**24 documents
        both.sort()
        found, owner = both >> np.uint64(24), (both & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = _runs(found)
        value = np.repeat(logp[np.searchsorted(known, found[at[:-1]])].astype(np.float64), np.diff(at))
        part = np.bincount(owner, value)
        total[lo : lo + len(part)] += part
    return total


def _model(totals: DataFrame) -> DataFrame:
    """(g, logp) of every gram in `totals` (g, n): all that occur, with their counts in trusted text."""
    mask = lambda c, k: c.bitwiseAND(F.lit((1 << 8 * k) - 1))
    count, asked = totals.where("n > 0").select("g", F.col("n").alias("c")), totals.select("g")
    levels = []
    for k in range(ORDER, 0, -1):
        count = staged(count, f"count{k}")
        of = count.agg(*[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (max(1, of[i]) for i in range(4))
        y = n1 / (n1 + 2 * n2)
        d = [0.0, *(min(max(0.05, i - (i + 1) * y * b / a), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
        levels.append((k, count, asked, d))
        if k > 1:
            count = count.groupBy(mask(F.col("g"), k - 1).alias("g")).agg(F.count("*").alias("c"))
            asked = staged(asked.select(mask(F.col("g"), k - 1).alias("g")).distinct(), f"asked{k - 1}")
    below: DataFrame | None = None
    for k, count, asked, d in reversed(levels):
        context = F.shiftright("g", 8)
        cut = F.when(F.col("c") >= 3, d[3]).when(F.col("c") == 2, d[2]).otherwise(d[1])
        sums = count.groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
        got = asked.withColumn("h", context).join(sums, "h", "left").join(count, "g", "left")
        top = F.coalesce((F.col("c") - cut) / F.col("total"), F.lit(0.0))
        share = F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0))
        if below is None:
            got = got.select("g", (top + share / 256).alias("p"))
        else:
            got = got.withColumn("s", mask(F.col("g"), k - 1)).join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
            got = got.select("g", (top + share * F.col("lower")).alias("p"))
        used = [count, *([asked] if k < ORDER else []), *([below] if below is not None else [])]
        below = staged(got, f"p{k}")
        for old in used:  # nothing reads these again
            drop_staged(old)
    return below.select("g", F.log("p").alias("logp"))


def score(documents: DataFrame, trusted: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, lang, trusted, held_out, n (bytes), perplexity per byte (null for a null or empty text); one row per document row.

    trusted: a table whose first column holds the ids of trusted documents; other ids, null ones and repeats don't matter. One in `held_out`
    of them, by a hash of the id, is not counted in the model; where that would leave none to count, all are counted and none is held out.
    """
    unit_rows, n = units(documents.withColumn("__lang", F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))), id_col, text_col, extra="__lang")
    bits = max(1, (n - 1).bit_length())
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).where("id is not null")
    out = F.crc32(F.col("id").cast("string")) % held_out == 0
    if ids.where(~out).isEmpty():
        out = F.lit(False)
    good_rows = ids.select(unit_of(F.col("id"), F.lit(None).cast("string"), n).alias("unit"), "id", out.alias("out")).repartition(n, "unit")

    def by_shard(known: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        """The shards that some ascending grams go to, and the places of each one's grams."""
        shard = (mix(known) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        at = _runs(shard[order])
        return shard[order][at[:-1]].tolist(), [order[a:b] for a, b in zip(at, at[1:], strict=False)]

    def forward(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        docs = unpack(left.column("blob").to_pylist())
        good = set(right.filter(pc.invert(right.column("out"))).column("id").to_pylist())
        known, counts = _asks(docs, [d.id in good for d in docs])
        some, parts = by_shard(known)
        return pa.table(
            {
                "rng": pa.array(some, pa.int32()),
                "unit": pa.array(np.full(len(some), key[0].as_py()), pa.int32()),
                "keys": pa.array([_squeeze(known[m]) for m in parts], pa.binary()),
                "loads": pa.array([_squeeze(counts[m].astype(np.uint32)) for m in parts], pa.binary()),
            }
        )

    def add(key: tuple, group: pa.Table) -> pa.Table:
        keys = np.concatenate([_unsqueeze(x, U8) for x in group.column("keys").to_pylist()])
        loads = np.concatenate([_unsqueeze(x, np.dtype(np.uint32)) for x in group.column("loads").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], _runs(keys[order])
        known, total = keys[at[:-1]], np.add.reduceat(loads[order].astype(np.int64), at[:-1])
        return pa.table({"rng": pa.array(np.full(len(known), key[0].as_py()), pa.int32()), "g": pa.array(known.astype(np.int64)), "n": pa.array(total)})

    def reply(left: pa.Table, right: pa.Table) -> pa.Table:
        g, p = np.asarray(right.column("g")).astype(np.uint64), np.asarray(right.column("logp"))
        order = np.argsort(g)
        g, p = g[order], p[order].astype(np.float32)
        out = [_squeeze(p[np.searchsorted(g, _unsqueeze(x, U8))]) for x in left.column("keys").to_pylist()]
        return pa.table({"unit": left.column("unit"), "rng": left.column("rng"), "reply": pa.array(out, pa.binary())})

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = unpack(left.column("blob").to_pylist())
        known, _ = _asks(docs, [False] * len(docs))
        shards = dict(zip(*by_shard(known), strict=True))
        logp = np.zeros(len(known), np.float32)
        good: dict[int, bool] = {}
        for s, raw, id_, out in zip(*(right.column(c).to_pylist() for c in ("rng", "reply", "id", "out")), strict=True):
            if raw is None:
                good[id_] = out
            else:
                logp[shards[s]] = _unsqueeze(raw, np.dtype(np.float32))
        sizes = [len(d.text or b"") for d in docs]
        mean = [x / n if n else None for x, n in zip(_sums(docs, known, logp).tolist(), sizes, strict=True)]
        return pa.table(
            {
                "doc_id": pa.array([None if d.id == NULL_ID else d.id for d in docs], pa.int64()), "lang": pa.array([d.extra for d in docs], pa.string()), "trusted": pa.array([d.id in good for d in docs], pa.bool_()), "held_out": pa.array([good.get(d.id, False) for d in docs], pa.bool_()),
                "n": pa.array(sizes, pa.int64()), "perplexity": pa.array([None if m is None else float(np.exp(-m)) for m in mean], pa.float64()),
            }
        )

    # staged, as it is read twice: the texts' grams are found once for it, and once more where the replies arrive
    asked = staged(unit_rows.groupBy("unit").cogroup(good_rows.groupBy("unit")).applyInArrow(forward, "rng int, unit int, keys binary, loads binary"), "asked")
    release(documents.sparkSession)
    sent = asked.repartition(1 << bits, "rng")
    totals = staged(sent.groupBy("rng").applyInArrow(add, "rng int, g long, n long"), "totals")
    release(documents.sparkSession)
    model = _model(totals.select("g", "n")).join(totals.select("g", "rng"), "g")
    release(documents.sparkSession)
    back = sent.groupBy("rng").cogroup(model.select("rng", "g", "logp").repartition(1 << bits, "rng").groupBy("rng")).applyInArrow(reply, "unit int, rng int, reply binary")
    both = back.withColumn("id", F.lit(None).cast("long")).unionByName(good_rows.select("unit", "id", "out"), allowMissingColumns=True)
    return unit_rows.groupBy("unit").cogroup(both.repartition(n, "unit").groupBy("unit")).applyInArrow(total, "doc_id long, lang string, trusted boolean, held_out boolean, n long, perplexity double")


def classify(documents: DataFrame, trusted: DataFrame, quantile: float = 0.99, **names) -> DataFrame:
    """score(), with threshold and keep.

    The threshold of a language is the `quantile` (by a mergeable summary, rank error 1e-5) of its held-out trusted texts' perplexities; where a
    language has none, that of all held-out texts; where none is held out, that of all trusted texts; where nothing is trusted, all texts are
    kept. A null or empty text has no perplexity and isn't kept. A null language is `und`. Repeated rows are scored each and count each; an
    empty table gives no rows; the input must read the same each time.
    """
    scored = staged(score(documents, trusted, **names), "scored")
    good = scored.where(F.col("trusted") & F.col("perplexity").isNotNull())
    limit = lambda col: F.percentile_approx(col, quantile, 100_000).alias("threshold")
    unseen = F.when(F.col("held_out"), F.col("perplexity"))
    by_lang = staged(good.where("held_out").groupBy("lang").agg(limit("perplexity")), "thresholds")
    overall = good.agg(F.coalesce(limit(unseen), limit("perplexity")).alias("threshold")).first()["threshold"]
    threshold = F.coalesce("threshold", F.lit(overall).cast("double"))
    joined = scored.join(by_lang, "lang", "left").withColumn("threshold", threshold)
    keep = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return joined.select("doc_id", "lang", "trusted", "n", "perplexity", "threshold", keep.alias("keep"))
