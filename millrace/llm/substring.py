"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text (each byte doubles the hash and adds the byte's random number); a chunk ends where the low bits
are zero, at a least and a greatest size, so boundaries depend on the bytes near them and shift with insertions. Chunks are told apart by
128-bit digests; of the chunks with one digest, the earliest of the document with the smallest id stays. Adjacent repeated chunks form a
passage, and passages of at least `min_bytes` are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import Spans
from .roundtrip import NULL_ID, Doc, round_trip, units

_GEAR = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64)
LEAST, BITS, MOST = 16, 4, 256


def boundaries(buf: np.ndarray, least: int = LEAST, bits: int = BITS, most: int = MOST) -> np.ndarray:
    """Ends of the chunks of one text."""
    h = _GEAR[buf]
    for shift in (1, 2, 4, 8, 16, 32):  # after these, h[i] holds the last 64 bytes: what rolling by one doubling a byte gives
        if shift >= len(h):
            break
        h[shift:] = h[shift:] + (h[:-shift] << np.uint64(shift))
    cuts = np.flatnonzero((h >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0) + 1
    ends, last = [], 0
    for c in cuts.tolist():
        while c - last > most:
            last += most
            ends.append(last)
        if c - last >= least:
            ends.append(c)
            last = c
    while len(buf) - last > most:
        last += most
        ends.append(last)
    if len(buf) > last:
        ends.append(len(buf))
    return np.array(ends, np.int64)


LOAD = np.dtype([("check", np.uint64), ("doc", np.int64)])


def _asks(docs: list[Doc]):
    """Each digest of the unit once, with its second half and its smallest document; the state maps chunks to them."""
    lows, checks, owners, begins, ends = [], [], [], [], []
    for i, d in enumerate(docs):
        buf = np.frombuffer(d.text or b"", np.uint8)
        end = boundaries(buf)
        if len(end):
            start = np.concatenate([[0], end[:-1]])
            lows.append(Spans(buf).hash(start, end))
            checks.append(Spans(buf, 1).hash(start, end))
            owners.append(np.full(len(end), i))
            begins.append(start)
            ends.append(end)
    if not lows:
        return np.zeros(0, np.uint64), np.zeros(0, LOAD), None
    low, check, owner, begin, end = map(np.concatenate, (lows, checks, owners, begins, ends))
    ids = np.array([d.id for d in docs], np.int64)
    order = np.lexsort((begin, ids[owner], check, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order][1:] != low[order][:-1]) | (check[order][1:] != check[order][:-1])
    group = np.cumsum(new) - 1
    slot = np.empty(len(order), np.int64)
    slot[order] = group
    first = order[new]
    loads = np.zeros(len(first), LOAD)
    loads["check"], loads["doc"] = check[first], ids[owner[first]]
    return low[first], loads, (slot, first, owner, begin, end)


def _answer(keys: np.ndarray, loads: np.ndarray, who: np.ndarray) -> np.ndarray:
    """The smallest document that holds the digest."""
    order = np.lexsort((loads["doc"], loads["check"], keys))
    k, c = keys[order], loads["check"][order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = loads["doc"][order][new][np.cumsum(new) - 1]
    same = out == loads["doc"]
    out[same] = -1  # the unit's own: shrinks to nothing on the way back
    return out


def _use(min_bytes: int, with_text: bool):
    def use(docs: list[Doc], state, got: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = np.array([d.id for d in docs], np.int64)
        rows: list[tuple] = []
        if state is not None:
            slot, first, owner, begin, end = state
            unit_first = ids[owner[first]]
            holder = np.where(got < 0, unit_first, got)[slot]
            keeps = (holder == ids[owner]) & (first[slot] == np.arange(len(slot)))
            same_id_again = (holder == ids[owner]) & (owner[first[slot]] != owner)  # a row that repeats an id is the same document
            dup = ~keeps & ~(same_id_again & (ids[owner] != NULL_ID))
            cut = np.searchsorted(owner, np.arange(len(docs) + 1))
        for i, d in enumerate(docs):
            spans: list[dict] = []
            n = 0
            if state is not None:
                a, b = cut[i], cut[i + 1]
                n = int(b - a)
                flags = np.diff(np.concatenate([[0], dup[a:b].astype(np.int8), [0]]))
                for x, y in zip(np.flatnonzero(flags == 1), np.flatnonzero(flags == -1), strict=True):
                    s, e = int(begin[a + x]), int(end[a + y - 1])
                    if e - s >= min_bytes:
                        spans.append({"start": s, "length": e - s, "chunks": int(y - x), "first_doc_id": None if holder[a + x] == NULL_ID else int(holder[a + x])})
            text = None
            if with_text and d.text is not None:
                at, kept = 0, []
                for s in spans:
                    kept.append(d.text[at : s["start"]])
                    at = s["start"] + s["length"]
                text = (b"".join(kept) + d.text[at:]).decode(errors="ignore")
            rows.append((None if d.id == NULL_ID else d.id, text, n, spans))
        cols = list(zip(*rows, strict=True))
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("chunks", pa.int32()), ("first_doc_id", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), span), strict=True)], ["doc_id", "text", "n_chunks", "removed"])

    return use


def dedup_substrings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 120, with_text: bool = True) -> DataFrame:
    """doc_id, text (what stays), n_chunks, removed: array of (start, length in bytes, chunks, first_doc_id), one row per document.

    A null text stays null and has no chunks. Rows that repeat a doc_id are one document: what they share with each other stays in each.
    A null id comes last, so its text is cut in favour of any other document. Where a cut would split a character, its bytes go with it.
    The input must give the same rows each time it is read. An empty table gives no rows; other columns are not read.
    """
    rows, n = units(documents, id_col, text_col)
    schema = "doc_id long, text string, n_chunks int, removed array<struct<start:long,length:long,chunks:int,first_doc_id:long>>"
    return round_trip(rows, n, _asks, _answer, _use(min_bytes, with_text), schema, LOAD, np.dtype(np.int64))
