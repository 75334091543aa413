"""Counts and first holders over all texts, by a round trip of keys.

Texts are dealt into units by a hash of their id, so a unit holds the same rows however often it is computed. Each unit asks about its
sorted 64-bit keys; the keys go, split by their top bits into ranges and compressed, to one task per range, which sees every unit's keys of
its range, and answers go back to the unit, aligned with its keys. A key that half of the texts hold is one key per unit on the way, so no
task gathers a group. Units and ranges are sized by the bytes of the table; the units' exchange is used by both passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

UNIT_BYTES = 8 << 20
#: Units of a small table, so that its work is spread.
LEAST = 64
NULL_ID = 2**63 - 1


class Doc(NamedTuple):
    """id is NULL_ID for a null id; text is None for a null text."""

    id: int
    text: bytes | None
    extra: str | None


def _pack(docs: list[tuple]) -> bytes:
    ids = np.array([d[0] for d in docs], np.int64)
    sizes = np.array([-1 if d[1] is None else len(d[1]) for d in docs], np.int64)
    more = np.array([-1 if d[2] is None else len(d[2]) for d in docs], np.int64)
    raw = b"".join([np.int64(len(docs)).tobytes(), ids.tobytes(), sizes.tobytes(), more.tobytes(), *(d[1] or b"" for d in docs), *(d[2] or b"" for d in docs)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blobs: list[bytes]) -> list[Doc]:
    out = []
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids, sizes, more = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
        at = 8 + 24 * n
        texts: list[bytes | None] = []
        for size in sizes:
            texts.append(None if size < 0 else raw[at : at + size])
            at += max(0, int(size))
        for doc, text, size in zip(ids, texts, more, strict=True):
            out.append(Doc(int(doc), text, None if size < 0 else raw[at : at + size].decode()))
            at += max(0, int(size))
    return sorted(out, key=lambda d: (d.id, d.text or b"", d.text is None, d.extra or ""))


def _to_units(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for unit, docs in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([_pack(docs)], pa.binary())], ["unit", "blob"])
            held.clear()

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for unit, doc, text, extra in zip(*cols, strict=True):
                held.setdefault(unit, []).append((NULL_ID if doc is None else doc, text, extra))
                size += len(text or b"")
            if size >= limit:
                yield from flush()
                size = 0
        yield from flush()

    return run


def unit_of(doc: Column, text: Column, n: int) -> Column:
    """By the id, so that other tables can be dealt alike; rows without an id by their text."""
    return F.pmod(F.when(doc.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc.cast("long"))), F.lit(n)).cast("int")


def units(docs: DataFrame, id_col: str, text_col: str, extra: str | None = None, least: int | None = None, unit_bytes: int = UNIT_BYTES) -> tuple[DataFrame, int]:
    """(unit, blob) rows of a table, dealt by unit; and the number of units."""
    n = max(least or LEAST, -(-text_bytes(docs, text_col) // unit_bytes))
    key = unit_of(F.col(id_col), F.col(text_col), n)
    rows = docs.select(key.alias("unit"), F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"), (F.encode(F.col(extra).cast("string"), "UTF-8") if extra else F.lit(None).cast("binary")).alias("extra"))
    return rows.mapInArrow(_to_units(64 << 20), "unit int, blob binary").repartition(n, "unit"), n


def _squeeze(a: np.ndarray) -> bytes:
    """Planes of bytes, so that the leading bytes of ascending keys and small answers shrink."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(raw: bytes, dtype: np.dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def round_trip(
    unit_rows: DataFrame,
    n_units: int,
    asks: Callable[[list[Doc]], tuple],
    answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    use: Callable[[list[Doc], tuple, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    load: np.dtype,
    reply: np.dtype,
    low_bits: int = 64,
) -> DataFrame:
    """asks(docs) -> (ascending keys, loads, state); answer(keys, loads, units) -> replies; use(docs, state, replies) -> rows.

    A range's task gets the keys' next `low_bits` (32 or 64) bits below those that name the range.
    """
    load, reply = np.dtype(load), np.dtype(reply)
    top = max(1, (n_units - 1).bit_length())
    ranges = 1 << top
    low = np.dtype(np.uint32 if low_bits == 32 else np.uint64)

    def edges(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys >> np.uint64(64 - top), np.arange(ranges + 1, dtype=np.uint64))

    def forward(key: tuple, group: pa.Table) -> pa.Table:
        keys, loads, _ = asks(unpack(group.column("blob").to_pylist()))
        at = edges(keys)
        part = keys if low_bits == 64 else ((keys << np.uint64(top)) >> np.uint64(32)).astype(np.uint32)
        some = np.flatnonzero(np.diff(at))
        return pa.table(
            {
                "rng": pa.array(some, pa.int32()),
                "unit": pa.array(np.full(len(some), key[0].as_py()), pa.int32()),
                "keys": pa.array([_squeeze(part[at[r] : at[r + 1]]) for r in some], pa.binary()),
                "loads": pa.array([_squeeze(loads[at[r] : at[r + 1]]) for r in some], pa.binary()),
            }
        )

    def middle(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("unit")
        parts = [_unsqueeze(x, low) for x in group.column("keys").to_pylist()]
        sizes = [len(p) for p in parts]
        who = np.repeat(np.asarray(group.column("unit")), sizes)
        got = answer(np.concatenate(parts), np.concatenate([_unsqueeze(x, load) for x in group.column("loads").to_pylist()]), who).astype(reply)
        cut = np.cumsum([0, *sizes])
        return pa.table({"unit": group.column("unit"), "rng": group.column("rng"), "reply": pa.array([_squeeze(got[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())})

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = unpack(left.column("blob").to_pylist())
        if not docs:
            return pa.Table.from_batches([], schema=arrow)
        keys, _, state = asks(docs)
        right = right.sort_by("rng")
        parts = [_unsqueeze(x, reply) for x in right.column("reply").to_pylist()]
        got = np.concatenate(parts) if parts else np.zeros(0, reply)
        if len(got) != len(keys):
            raise RuntimeError("a unit changed between two passes: the input must be the same each time it is read")
        return pa.Table.from_batches(list(use(docs, state, got)), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spec = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spec)
    sent = unit_rows.groupBy("unit").applyInArrow(forward, "rng int, unit int, keys binary, loads binary")
    answered = sent.repartition(ranges, "rng").groupBy("rng").applyInArrow(middle, "unit int, rng int, reply binary")
    return unit_rows.groupBy("unit").cogroup(answered.repartition(n_units, "unit").groupBy("unit")).applyInArrow(back, spec)
