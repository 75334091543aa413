"""Best-fit packing of token pieces by a configuration linear program.

The program's rows are piece lengths (at most the capacity, so the histogram is bounded), its columns are patterns that fill one sequence.
Multiplicative weights solve it: each round prices the lengths by their weights, a knapsack dynamic programme over the capacity finds the
dearest pattern, the pattern is taken as often as its scarcest length allows, and the weights of what it covers fall. Multiplicities are
rounded down, and what is left of the histogram goes best-fit, longest first, by counts. Only the histogram and the patterns are on the
driver; pieces get a rank within their length by two-level counting, and ranks map to places by binary search in the pattern table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged

CAPACITY = 2048


def _pieces(path: str, capacity: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .wordbpe import WordBpe

        bpe = WordBpe(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = bpe.ids(text.as_py() or "") + b"\0\0\0\0"
                for start in range(0, len(raw) // 4, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    for column, x in zip(out, (doc, start // capacity, start, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(x)
            types = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def knapsack(lengths: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """The pattern of highest value: index of a length -> how often. Repeats beyond a limit are cut afterwards."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.argsort(lengths, kind="stable")
    ls, vs = lengths[order], values[order]
    fits = np.searchsorted(ls, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        if n := fits[c]:
            got = vs[:n] + best[c - ls[:n]]
            i = int(np.argmax(got))
            if got[i] > best[c]:
                best[c], pick[c] = got[i], i
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
            continue
        i = int(order[pick[c]])
        out[i] = out.get(i, 0) + 1
        c -= int(lengths[i])
    return {i: min(n, int(limits[i])) for i, n in out.items()}


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 120, step: float = 0.5) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns and their fractional multiplicities, which cover no length more than its count."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.float64)
    weight, covered = np.ones(len(lengths)), np.zeros(len(lengths))
    patterns: dict[tuple, float] = {}
    for _ in range(rounds if len(lengths) else 0):
        pattern = knapsack(lengths, weight / counts * lengths, counts, capacity)
        if not pattern:
            break
        idx, n = np.array(list(pattern)), np.array(list(pattern.values()), np.float64)
        times = float((counts[idx] / n).min())
        covered[idx] += times * n / counts[idx]
        weight[idx] *= np.exp(-step * times * n / counts[idx])
        key = tuple(sorted(pattern.items()))
        patterns[key] = patterns.get(key, 0.0) + times
    scale = 1.0 / max(1.0, covered.max(initial=0.0))
    return [dict(k) for k in patterns], np.array(list(patterns.values())) * scale


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern: length -> how often, number of sequences) that use every piece of the histogram exactly once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    for pattern, x in zip(*solve(lengths, counts, capacity), strict=True):
        n = min([int(x + 1e-9), *(int(left[i]) // k for i, k in pattern.items())])
        if n and sum(int(lengths[i]) * k for i, k in pattern.items()) >= 0.995 * capacity:  # looser ones go best-fit
            out.append(({int(lengths[i]): k for i, k in pattern.items()}, n))
            for i, k in pattern.items():
                left[i] -= n * k
    bins: dict[int, dict[tuple, int]] = {}  # room left -> pattern -> number of sequences

    def put(room: int, pattern: tuple, n: int) -> None:
        held = bins.setdefault(room, {})
        held[pattern] = held.get(pattern, 0) + n

    for i in np.argsort(-lengths, kind="stable"):
        size, todo = int(lengths[i]), int(left[i])
        while todo:
            room = min((r for r in bins if r >= size), default=None)
            if room is None:
                k = min(capacity // size, todo)
                put(capacity - k * size, ((size, k),), todo // k)
                todo %= k
                continue
            pattern, n = bins[room].popitem()
            if not bins[room]:
                del bins[room]
            k = min(room // size, todo)
            used = min(n, todo // k)
            put(room - k * size, (*pattern, (size, k)), used)
            if n > used:
                put(room, pattern, n - used)
            todo -= used * k
    for held in bins.values():
        for pattern, n in held.items():
            merged: dict[int, int] = {}
            for size, k in pattern:
                merged[size] = merged.get(size, 0) + k
            out.append((merged, n))
    return out


def _slots(planned: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): length, first rank, first sequence, place in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in planned:
        at = 0
        for size, k in sorted(pattern.items(), reverse=True):
            for _ in range(k):
                rows.append((size, used.get(size, 0), sequence, at))
                used[size] = used.get(size, 0) + n
                at += size
        sequence += n
    found = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(found.T)


def _place(slots, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, sequence, at = slots.value
        key = size.astype(np.uint64) << np.uint64(48) | first.astype(np.uint64)
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            i = np.searchsorted(key, length.astype(np.uint64) << np.uint64(48) | rank.astype(np.uint64), "right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence[i] + rank - first[i]), pa.array(at[i])], [*names, "sequence_id", "offset"])

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A document is its ids followed by id 0, so a null or empty text is one piece of length 1. Only documents longer than `capacity` are cut,
    into full pieces and a last one. Repeated rows are documents of their own, and a null id stays null. An empty table packs to no rows.
    Other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = staged(docs.mapInArrow(_pieces(tokenizer_path, capacity, pa.int64()), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    lengths, counts = (np.array([r[i] for r in histogram], np.int64) for i in range(2))
    slots = spark.sparkContext.broadcast(_slots(plan(lengths, counts, capacity)))
    blocks = max(64, int(counts.sum()) // block_rows)
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = blocked.withColumn("nth", F.row_number().over(within)).join(offsets, ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place(slots, pa.int64()), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
