"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit separates the languages whose bit is 1 from those whose bit is 0, on hashed byte
n-grams (naive Bayes log-odds over counts of every labelled text, each language weighing the same). A text's bits have margins; decoding
sums a logistic loss of margin times codeword bit, weighted by how well the bit's two classes separate, and takes the language of least
loss. A text whose second-best codeword is nearly as close is flagged ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
MAX_LANGUAGES = 512
#: ASCII letters in lower case and bytes of other characters stay, the rest becomes a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CHUNK = 32 << 10
_PART = 1 << 20
_DECODED = 64


def _parts(batch: pa.RecordBatch, column: int | str) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, in slices of about _PART bytes of text: a worker keeps the memory it once had, and Python needs several times a text's."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // _PART, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(sizes)], strict=False):
        yield batch.slice(a, b - a)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Each text folded, in pieces of at most _CHUNK bytes behind the four bytes (blanks at first) that the n-grams of its first bytes reach."""
    for i, t in enumerate(texts):
        folded = b"    " + re.sub(b"  +", b" ", t.translate(_FOLD)).strip(b" ") + b" "
        for a in range(4, len(folded), _CHUNK):
            yield i, folded[a - 4 : a + _CHUNK]


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Buckets of the n-grams of some pieces, one row per order and byte; where each piece begins, and where the last ends; whose each is."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= _CHUNK:
            yield _buckets(held)
            held, size = [], 0
    if held:
        yield _buckets(held)


def _buckets(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    buf = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).astype(np.uint32)
    out = []
    value = np.zeros(len(buf), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        value = value | np.concatenate([np.zeros(n - 1, np.uint32), buf[: len(buf) - n + 1]]) << np.uint32(8 * (n - 1))
        if n in ORDERS:
            out.append((value * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(16))
    return np.stack(out), np.cumsum([0] + [len(p) for _, p in pieces]), [i for i, _ in pieces]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for part in (part for batch in batches for part in _parts(batch, 0)):
        texts, langs = (part.column(i).to_pylist() for i in range(2))
        for lang in set(langs):
            mine = [t.encode() for t, x in zip(texts, langs, strict=True) if x == lang]
            total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for grams, starts, _ in _grams(mine):
                inside = np.ones(grams.shape[1], bool)
                inside[(starts[:-1, None] + np.arange(4)).ravel()] = False
                total += np.bincount(grams[:, inside].ravel(), minlength=BUCKETS)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of bits (-1, 1): all splits for up to five languages, else the random code of the greatest least distance of 64."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = [[1 if k == 0 or not split >> (k - 1) & 1 else -1 for k in range(n)] for split in range(1, 2 ** (n - 1))]
        return np.array(bits, np.int8).T
    rng, width, best, far = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(n))), None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        code[0, (code == code[0]).all(0)] *= -1
        distance = (width - code.astype(int) @ code.T.astype(int)) // 2 + width * np.eye(n, dtype=int)
        if distance.min() > far:
            best, far = code, int(distance.min())
    return best


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords, weights (bucket x bit) and bit weights. What reaches the driver is at most BUCKETS counts a language."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MAX_LANGUAGES} are meant")
    counts = np.zeros((len(langs), BUCKETS))
    lang_at = {x: i for i, x in enumerate(langs)}
    counts[[lang_at[x] for x in sums.column("lang").to_pylist()], np.asarray(sums.column("bucket"))] = np.asarray(sums.column("n"))
    share = (counts + 0.05) / (counts + 0.05).sum(1, keepdims=True) if len(langs) else counts
    code = codewords(len(langs))
    weights, worth = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(one) and len(zero):
            p, q = one.mean(0), zero.mean(0)
            weights[:, b] = np.log(p / q)
            worth[b] = (0.5 * (p - q) * np.log(p / q)).sum()  # how far apart the classes are
    return langs, code, weights, worth / worth.mean()


def _predict(model, ambiguous_below: float, with_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, code, weights, worth = model.value
        for part in (part for batch in batches for part in _parts(batch, "text")):
            texts = part.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if langs else []
            raw = [texts[i].encode() for i in known]
            lang, score, unclear = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            totals = np.zeros((len(raw), code.shape[1]))
            for grams, starts, owners in _grams(raw):
                margin = weights[grams[0]]
                for g in grams[1:]:
                    margin += weights[g]
                margin[(starts[:-1, None] + np.arange(4)).ravel()] = 0
                np.add.at(totals, owners, np.add.reduceat(margin, starts[:-1], axis=0, dtype=np.float64) / len(ORDERS))
            for a in range(0, len(known), _DECODED):
                loss = (np.logaddexp(0.0, -totals[a : a + _DECODED, None, :] * code[None, :, :]) * worth).sum(2)
                likely = np.exp(loss.min(1, keepdims=True) - loss)
                likely /= likely.sum(1, keepdims=True)
                for k, at in enumerate(known[a : a + _DECODED]):
                    best = int(loss[k].argmin())
                    lang[at], score[at], unclear[at] = langs[best], likely[k, best], likely[k, best] < ambiguous_below
            names = [n for n in part.schema.names if n != "text" or with_text]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang), pa.array(score), pa.array(unclear)], [*names, "lang_pred", "score", "ambiguous"])

    return run


def identify(documents: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ambiguous_below: float = 0.6, keep: dict[str, Column] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous, and the columns in `keep`, per row; with `with_text` the text as a string, named text.

    Learns from the text and non-null label of rows where `training` is true, and predicts from the text alone. A null text, and one
    without a letter, is `und` with score 0, as is everything where nothing is labelled. Ties go to the language first by name; repeated
    rows are predicted each; a null id is returned as it is. An empty table gives no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents.where(F.coalesce(training, F.lit(False))), text_col, lang_col))
    kept = {id_col: F.col(id_col)} | (keep or {})
    rows = documents.select(*(c.alias(n) for n, c in kept.items()), F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"`{n}` {t}" for n, t in (rows if with_text else rows.drop("text")).dtypes)
    return rows.mapInArrow(_predict(model, ambiguous_below, with_text), f"{fields}, lang_pred string, score double, ambiguous boolean")
