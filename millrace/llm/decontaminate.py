"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are folded alike (A-Z lower-cased, ASCII other than letters and digits to single blanks). An item of m bytes that lies in a
text with at most k edits keeps at least m - q + 1 - k*q of its q-grams, all within 2k + 1 neighbouring diagonals (place in the text less place
in the item). Diagonals are cut into bands twice that wide that overlap by half, so one band holds them all; bands with fewer distinct
q-grams of the item can't match and go, and what remains is verified by an alignment that fills the cells of the band only. The benchmark is
read in shards of bounded size, one after another, each of which meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged, text_bytes

Q, EDIT_RATE = 8, 0.1
MAX_INDEX_BYTES, SEGMENT = 16 << 20, 1 << 20
#: Hits of q-grams that are held at a time.
HITS = 1 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_SALT = np.uint64(0x9E3779B97F4A7C15)


def fold(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_FOLD).split())


def _grams(raw: bytes) -> np.ndarray:
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for o in range(min(Q, n)):
        out[o::Q] = np.frombuffer(raw, "<u8", (len(raw) - o) // 8, o)[: len(out[o::Q])]
    return out


class Items:
    def __init__(self, items: list[tuple[int, bytes]], edit_rate: float):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.size = size
        self.budget = np.minimum((edit_rate * size).astype(np.int64), np.maximum(0, (size - Q) // Q))
        self.need = np.maximum(1, size - Q + 1 - self.budget * Q)
        self.short = [i for i, n in enumerate(size) if 0 < n < Q]
        grams = [_grams(t) for t in self.texts]
        gram, item, at = np.concatenate([np.zeros(0, np.uint64), *grams]), np.repeat(np.arange(len(items)), [len(g) for g in grams]), np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(gram, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.first = np.unique(gram[order], return_index=True)
        self.last = np.append(self.first[1:], len(gram))
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(self.keys * _SALT) >> np.uint64(43)] = True
        self.reach = int(size.max(initial=0) + 2 * self.budget.max(initial=0)) + 16

    def candidates(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(item, first, last diagonal) of the bands that may hold an item."""
        grams = _grams(raw)
        hit = np.flatnonzero(self.maybe[(grams * _SALT) >> np.uint64(43)])
        if not len(hit) or not len(self.keys):
            return []
        slot = np.minimum(np.searchsorted(self.keys, grams[hit]), len(self.keys) - 1)
        same = self.keys[slot] == grams[hit]
        hit, slot = hit[same], slot[same]
        if not len(hit):
            return []
        n = self.last[slot] - self.first[slot]
        keys: list[np.ndarray] = []
        for a, b in self._slices(n):  # a gram of many places in items, in a text that repeats it, makes many hits
            post = np.repeat(self.first[slot[a:b]] - np.concatenate([[0], np.cumsum(n[a:b])[:-1]]), n[a:b]) + np.arange(n[a:b].sum())
            place = np.repeat(hit[a:b], n[a:b])
            item, at = self.item[post], self.at[post]
            band = (place - at + self.reach) // (2 * self.budget[item] + 1)
            item, at, band = np.concatenate([item, item]), np.concatenate([at, at]), np.concatenate([band, band - 1])
            keys.append(np.unique((item * (len(raw) + 2 * self.reach) + band + 1) * (int(self.size.max()) + 1) + at))
            if sum(map(len, keys)) > 2 * HITS:
                keys = [np.unique(np.concatenate(keys))]
        distinct = np.unique(np.concatenate(keys)) // (int(self.size.max()) + 1)
        bands, count = np.unique(distinct, return_counts=True)
        which = bands // (len(raw) + 2 * self.reach)
        enough = count >= self.need[which]
        out = []
        for i, b in zip(which[enough].tolist(), (bands[enough] % (len(raw) + 2 * self.reach) - 1).tolist(), strict=True):
            w = int(2 * self.budget[i] + 1)
            out.append((i, b * w - self.reach, (b + 2) * w - 1 - self.reach))
        return out

    @staticmethod
    def _slices(n: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of places with about HITS hits each."""
        ends = np.cumsum(n)
        cuts = np.unique(np.searchsorted(ends, np.arange(HITS, int(ends[-1]) + HITS, HITS)) + 1)
        cuts = np.minimum(cuts, len(n)).tolist()
        return [(a, b) for a, b in zip([0, *cuts], cuts, strict=False) if b > a]

    def align(self, raw: bytes, i: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place of item i in raw on diagonals lo to hi, if it is within the budget.

        Row r of the alignment holds the places lo + r to hi + r of the text, a cell per diagonal: m * (hi - lo + 1) cells in all.
        """
        k, m = int(self.budget[i]), int(self.size[i])
        found = raw.find(self.texts[i], max(0, lo), max(0, min(len(raw), hi + m)))
        if found >= 0:
            return 0, found, found + m
        if not k:
            return None
        pattern, width = np.frombuffer(self.texts[i], np.uint8), hi - lo + 1
        before, after = max(0, -lo), max(0, hi + m - len(raw))  # the band may reach beyond the text's ends
        text = np.frombuffer(b"\0" * before + raw[max(0, lo) : min(len(raw), hi + m)] + b"\0" * after, np.uint8)
        far, idx = m + 1, np.arange(width)
        place = idx + lo  # of the cell in row 0: how much of the text lies before it
        row = np.where((place >= 0) & (place <= len(raw)), 0, far)  # the item may begin anywhere
        begin = place.copy()
        for r in range(m):
            best, src = row + (text[r : r + width] != pattern[r]), begin.copy()  # along the diagonal
            best[(place + r < 0) | (place + r >= len(raw))] = far
            down = row[1:] + 1  # a byte of the item that the text lacks: to the diagonal below
            less = down < best[:-1]
            best[:-1][less] = down[less]
            src[:-1][less] = begin[1:][less]
            slid = np.minimum.accumulate(best - idx) + idx  # bytes of the text that the item lacks: to diagonals above
            moved = slid < best
            if moved.any():
                src = src[np.maximum.accumulate(np.where(moved, 0, idx))]
            row, begin = np.minimum(slid, far), src
            row[place + r + 1 > len(raw)] = far
            if row.min() > k:
                return None
        end = int(row.argmin())
        return (int(row[end]), int(begin[end]), lo + end + m) if row[end] <= k else None

    def search(self, raw: bytes) -> dict[int, tuple[int, int, int]]:
        """item -> (edits, start, end), the fewest edits first, then the earliest."""
        best: dict[int, tuple[int, int, int]] = {}
        for o in range(0, max(1, len(raw)), SEGMENT):
            part = raw[o : o + SEGMENT + self.reach]
            for i, lo, hi in self.candidates(part):
                if best.get(i, (1,))[0] and (got := self.align(part, i, lo, hi)):
                    new = (got[0], got[1] + o, got[2] + o)
                    best[i] = min(best.get(i, new), new)
        for i in self.short:
            at = (b" " + raw + b" ").find(b" " + self.texts[i] + b" ")
            if at >= 0:
                best[i] = (0, at, at + len(self.texts[i]))
        return best


def _origins(raw: bytes) -> np.ndarray:
    """Place in the raw text of each byte of the folded one."""
    buf = np.frombuffer(raw.translate(_FOLD), np.uint8)
    solid = buf != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    first = np.flatnonzero(solid)
    return at[at >= first[0]] if len(first) else at[:0]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                found = items.search(fold(raw))
                at = _origins(raw) if found else None
                for i, (edits, a, b) in found.items():
                    start, end = int(at[a]), int(at[b - 1]) + 1
                    out.append((doc, items.ids[i], start, end - start, edits))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "start", "length", "edits"])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edit_rate: float = EDIT_RATE, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, start, length (bytes of the text), edits: one row per document row and item that it holds.

    An item lies in a text where at most edit_rate of its folded bytes are edited (fewer for items of under 8q bytes, so that a shared q-gram
    remains; items shorter than q must be there as whole words). Of several places, that of the fewest edits, then the first, is given. Null
    and empty texts and items hold and match nothing; items that repeat an id or text are each reported; a null id stays null. The benchmark
    is dealt by hash into shards of about max_index_bytes (a longer item alone makes a longer one); a shard at a time is read, broadcast and
    met by all documents, and what each finds is written before the next. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    shards = max(1, -(-text_bytes(items) // max_index_bytes))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    found = []
    for s in range(shards):
        held = [(r[0], fold((r[1] or "").encode())) for r in items.where(shard == s).orderBy("item_id", "text").collect()]  # about max_index_bytes
        shared = spark.sparkContext.broadcast(([(i, t) for i, t in held if t], edit_rate))
        part = docs.mapInArrow(_scan(shared), "doc_id long, item_id long, start long, length long, edits int")
        if shards > 1:
            part = staged(part, f"leaks{s}")
            shared.destroy()
        found.append(part)
    return reduce(DataFrame.unionByName, found)
