"""Exact top-k search by inner product.

Vectors are laid out in blocks of rows; queries are the rows that a predicate selects. Query tiles are dealt into groups of bounded size
and blocks into shards; a cell of this grid is one group of tiles, held in memory, that the blocks of one shard stream past. Each
(tile, block) pair is one matrix product followed by a partial selection of its k best. There are as many shards as keep the cluster busy, so
tiles are sent as often as there are shards, and blocks as often as there are groups, however many rows there are in a shard. A task keeps
a running list per tile; lists then merge in a tree whose fan-in is bounded, first within groups of cells, last per query.

Scores are exact: a product runs in float32 or float64 only where every partial sum is an integer that the type holds exactly, and in
Python integers otherwise; a score beyond a signed 64-bit integer is set to the nearest one that fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import staged, text_bytes

BLOCK_ROWS = 1024
#: Bytes of query tiles that a cell holds.
GROUP_BYTES = 128 << 20
MERGE_FAN_IN = 64
LOW, HIGH = -(2**63), 2**63 - 1


def _matrix(raw: bytes, ids: bytes, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.float64 if wide else np.float32).reshape(len(ids) // 8, dim)


def _quantise(values: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def _blocks(scale: float, rows: int):
    """Arrow batches (id, vec, is_query) -> one row per block; a block's rows have one length and ascend by id."""

    def emit(dim: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, mats, asks = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.argsort(ids, kind="stable")
        ids, mats, asks = ids[order], mats[order], asks[order]
        for a in range(0, len(ids), rows):
            i, m, q = ids[a : a + rows], mats[a : a + rows], asks[a : a + rows]
            narrow = m.astype(np.float32)
            wide = not np.array_equal(narrow.astype(np.float64), m)
            emit.seq += 1
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([TaskContext.get().partitionId() * 2**32 + emit.seq], pa.int64()),
                    "dim": pa.array([dim], pa.int32()),
                    "wide": [wide],
                    "n": pa.array([len(i)], pa.int32()),
                    "ids": [i.astype(np.int64).tobytes()],
                    "mat": [(m if wide else narrow).tobytes()],
                    "asks": [np.flatnonzero(q).astype(np.int32).tobytes()],
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit.seq = 0
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            ids, asks = np.asarray(batch.column(0)), np.asarray(batch.column(2).to_pylist(), dtype=bool)
            vec = batch.column(1)
            lengths = np.asarray(vec.value_lengths())
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            begins = np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                mat = flat[(begins[at][:, None] + np.arange(dim)[None, :])] if dim else np.zeros((len(at), 0))
                held.setdefault(int(dim), []).append((ids[at], _quantise(mat, scale), asks[at]))
                if sum(len(h[0]) for h in held[int(dim)]) >= 4 * rows:
                    yield from emit(int(dim), held.pop(int(dim)))
        for dim, parts in held.items():
            yield from emit(dim, parts)

    return run


def _products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    dim = q.shape[1]
    reach = float(np.abs(q).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(dim, 1)
    if reach < 2**24:
        return q.astype(np.float32) @ b.astype(np.float32).T
    if reach < 2**52:
        return q.astype(np.float64) @ b.astype(np.float64).T
    exact = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    out = exact(q).dot(exact(b).T) if dim else np.zeros((len(q), len(b)), dtype=object)
    return np.vectorize(lambda x: min(max(int(x), LOW), HIGH), otypes=[object])(out)


def _best(scores: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row, positions and scores of the k highest; equal scores go to the lower position. own: position not to take, or -1."""
    n = scores.shape[1]
    if scores.dtype == object or np.abs(scores).max(initial=0) * (n + 1) >= 2**52:
        out = []
        for row, skip in zip(scores, own, strict=True):
            at = sorted((i for i in range(n) if i != skip), key=lambda i: (-int(row[i]), i))[:k]
            out.append((np.array(at, dtype=np.int64), np.array([int(row[i]) for i in at], dtype=np.int64)))
        return out
    key = scores.astype(np.float64) * n - np.arange(n)
    mine = np.flatnonzero(own >= 0)
    key[mine, own[mine]] = -np.inf
    if n > k:
        at = np.argpartition(-key, k - 1, axis=1)[:, :k]
    else:
        at = np.broadcast_to(np.arange(n), key.shape)
    got = np.take_along_axis(key, at, axis=1)
    out = []
    for row, keys, pos in zip(scores, got, at, strict=True):
        keep = pos[np.isfinite(keys)]
        keep = keep[np.argsort(-keys[np.isfinite(keys)])]
        out.append((keep, row[keep].astype(np.int64)))
    return out


def _pairs(k: int, open_tiles: int = 32):
    """(tile, block) pairs -> candidate rows; runs of one tile keep a running top list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: dict[int, list] = {}

        def flush(tile: int) -> pa.RecordBatch:
            rows = [(tile, at, qid, int(v), int(s)) for at, (qid, ids, scores) in enumerate(running.pop(tile)) for v, s in zip(ids, scores, strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["tile", "at", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                q, b = _matrix(r["q_mat"], r["q_ids"], r["dim"], r["q_wide"]), _matrix(r["mat"], r["ids"], r["dim"], r["wide"])
                ids = np.frombuffer(r["ids"], np.int64)
                q_ids, q_block, q_pos = (np.frombuffer(r[c], np.int64) for c in ("q_ids", "q_block", "q_pos"))
                found = _best(_products(q, b), np.where(q_block == r["block"], q_pos, -1), k)
                old = running.get(r["tile"])
                new = []
                for i, (pos, score) in enumerate(found):
                    v, s = ids[pos], score
                    if old:
                        v, s = np.concatenate([old[i][1], v]), np.concatenate([old[i][2], s])
                        keep = np.lexsort((v, -s.astype(object) if s.min(initial=0) == LOW else -s))[:k]
                        v, s = v[keep], s[keep]
                    new.append((int(q_ids[i]), v, s))
                running[r["tile"]] = new
                if len(running) > open_tiles:
                    yield flush(next(iter(running)))
        for tile in list(running):
            yield flush(tile)

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query rows of each block as one tile."""
    for batch in batches:
        for r in batch.to_pylist():
            at = np.frombuffer(r["asks"], np.int32)
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {
                        "tile": pa.array([r["block"]], pa.int64()),
                        "dim": pa.array([r["dim"]], pa.int32()),
                        "q_wide": [r["wide"]],
                        "q_ids": [np.frombuffer(r["ids"], np.int64)[at].tobytes()],
                        "q_mat": [_matrix(r["mat"], r["ids"], r["dim"], r["wide"])[at].tobytes()],
                        "q_block": [np.full(len(at), r["block"], np.int64).tobytes()],
                        "q_pos": [at.astype(np.int64).tobytes()],
                    }
                )


def _packed(rows: int):
    """Tiles of one partition joined to tiles of about `rows` queries."""

    def join(held: list[dict]) -> pa.RecordBatch:
        wide = any(h["q_wide"] for h in held)
        mats = [_matrix(h["q_mat"], h["q_ids"], h["dim"], h["q_wide"]).astype(np.float64 if wide else np.float32) for h in held]
        cat = lambda c: b"".join(h[c] for h in held)
        return pa.RecordBatch.from_pydict({"tile": pa.array([held[0]["tile"]], pa.int64()), "dim": pa.array([held[0]["dim"]], pa.int32()), "q_wide": [wide], "q_ids": [cat("q_ids")], "q_mat": [np.concatenate(mats).tobytes()], "q_block": [cat("q_block")], "q_pos": [cat("q_pos")]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in _tiles(batches):
            r = batch.to_pylist()[0]
            held.setdefault(r["dim"], []).append(r)
            if sum(len(h["q_ids"]) // 8 for h in held[r["dim"]]) >= rows:
                yield join(held.pop(r["dim"]))
        for parts in held.values():
            yield join(parts)

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, block_rows: int = BLOCK_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: per query row its k highest inner products of floor(scale * x), ties to the smaller id.

    * Vectors that are null, or hold a null or non-finite component, take no part; nor do rows with a null id. A component so large that
      scale times it isn't finite counts as non-finite.
    * A query meets only vectors of its own length; an empty vector scores 0 against every other empty one.
    * Rows are told apart by place: a repeated id or row is a candidate like any other, and a repeated query row gets a list of its own;
      a query never meets its own row.
    * An empty table gives no rows; columns other than the two named are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    sound = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"), is_query.alias("is_query"))
    blocks = staged(
        rows.mapInArrow(_blocks(scale, block_rows), "block long, dim int, wide boolean, n int, ids binary, mat binary, asks binary"),
        "topk-blocks",
    )
    tiles = staged(blocks.where(F.octet_length("asks") > 0).mapInArrow(_packed(block_rows), "tile long, dim int, q_wide boolean, q_ids binary, q_mat binary, q_block binary, q_pos binary"), "topk-tiles")
    count = blocks.count()
    groups = max(1, -(-text_bytes(tiles, "q_mat") // group_bytes))
    shards = max(1, min(count, -(-4 * spark.sparkContext.defaultParallelism // groups)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = blocks.select("block", "dim", "wide", "ids", "mat", dealt("block", shards).alias("shard")).withColumn("group", everywhere(groups))
    sent = tiles.withColumn("group", dealt("tile", groups)).withColumn("shard", everywhere(shards))
    pairs = base.join(sent.hint("shuffle_hash"), ["shard", "group", "dim"])
    found = pairs.select("tile", "dim", "q_wide", "q_ids", "q_mat", "q_block", "q_pos", "block", "wide", "ids", "mat").mapInArrow(_pairs(k), "tile long, at int, query_id long, vec_id long, score long")
    lists = shards
    while lists > MERGE_FAN_IN:  # a tree: lists of some tasks first, then what is left of them
        lists = -(-lists // MERGE_FAN_IN)
        found = found.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(lists)))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("tile", "at", "g").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).drop("rank", "g")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("tile", "at").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
