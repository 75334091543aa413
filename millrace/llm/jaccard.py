"""Exact join of word-shingle sets on Jaccard similarity, as a metric-space join.

1 - Jaccard is a metric. Pivots create Voronoi regions: a text is at home with the nearest pivot within the radius (the greatest distance of two
linked texts), and linked to it. By the triangle inequality a partner of a text at home lies within twice the radius of that pivot, so the
texts of that window are replicated into the region as its boundary. Texts that no pivot is near stay in a remainder, which is joined again
with pivots of its own, and a region's home texts are joined with its boundary through pivots drawn from the boundary, within the windows
of both distances, until no region holds texts of two classes that could be linked. Equal sets are one text from the start.

Nearly all pairs of texts are at distance 1, where windows exclude nothing, so the space is first cut into blocks outside which no text
within the radius lies. The shingles of a text that other texts hold too are dealt by hash into parts; a pair within the radius differs in at most
H shingles, so of H + 1 parts some part is equal on both sides. Texts that agree in a whole part, one of the H + 1 whose shingles are rarest,
are a block. The pivots of the first round are the texts of least hash of each block. What no other text holds also bounds H, and with sketches
(the parities of the other shingles by SKETCH hash bits) it bounds the distance of two texts from below before their sets are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .kernels import mix, shingles
from .roundtrip import NULL_ID, Doc, round_trip, units
from .shared import Scratch, release, staged

Staged = Callable[[DataFrame, str], DataFrame]
WORDS, PERCENT = 5, 75
#: Bits of a sketch; more exclude more pairs of long texts, none excludes a pair within the threshold.
SKETCH = 512
LANES = [f"g{i}" for i in range(SKETCH // 64)]
LOAD = np.dtype([("n", np.uint8), ("check", np.uint32)])


def _digest(s: np.ndarray) -> tuple[np.uint64, np.uint32]:
    """Two hashes of a sorted set."""
    if not len(s):
        return np.uint64(0), np.uint32(1)
    place = mix(s ^ np.uint64(0xA0761D6478BD642F))
    one = mix(np.array([place.sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))[0]
    two = mix(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15))) + np.uint64(len(s))], np.uint64))[0]
    return one, np.uint32(two >> np.uint64(33)) | np.uint32(1)


def _asks_for(words: int):
    def asks(docs: list[Doc]):
        sets = list(shingles([d.text or b"" for d in docs], words))
        marks = [_digest(s) for s in sets]
        flat = np.concatenate([np.zeros(0, np.uint64), *sets, np.array([m[0] for m, s in zip(marks, sets, strict=True) if len(s)], np.uint64)])
        check = np.concatenate([np.zeros(len(flat) - sum(len(s) > 0 for s in sets), np.uint32), np.array([m[1] for m, s in zip(marks, sets, strict=True) if len(s)], np.uint32)])
        order = np.lexsort((check, flat))
        f, c = flat[order], check[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        slot = np.empty(len(f), np.int64)
        slot[order] = np.cumsum(new) - 1
        loads = np.zeros(int(new.sum()), LOAD)
        loads["n"] = np.minimum(np.bincount(slot, minlength=len(loads)), 255)
        loads["check"] = c[new]
        return f[new], loads, (sets, marks, slot)

    return asks


def _answer(keys: np.ndarray, loads: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Of a shingle: 0 if one text holds it, else a class that grows with how many. Of a set: 0 if no other is equal, 1 in the first unit, 2 in later ones."""
    order = np.lexsort((who, loads["check"], keys))
    k, c = keys[order], loads["check"][order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    total = np.bincount(group, loads["n"][order])[group] if len(k) else np.zeros(0)
    common = np.where(total > 1, 1 + np.log2(np.maximum(total, 1)).astype(np.int64), 0)
    copies = np.where(total > 1, np.where(new, 1, 2), 0)
    out = np.empty(len(k), np.uint8)
    out[order] = np.where(c == 0, np.minimum(common, 255), copies)
    return out


FIELDS = [("kind", pa.int32()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("shared", pa.bool_()), ("blocks", pa.list_(pa.int64())), ("shingles", pa.binary()), ("rare", pa.int32()), *((g, pa.int64()) for g in LANES)]
BARE = (None,) * (2 + len(LANES))


def _sketch(s: np.ndarray) -> list[int]:
    parity = np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()


def _edges(percent: int, most: int) -> list[int]:
    """Least sizes of the classes of sizes, up to two beyond that of `most`: sets within the threshold are of one class or of neighbouring ones."""
    out, beyond = [1], 0
    while beyond < 3:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
        beyond += out[-1] > most
    return out


def _blocks(held: np.ndarray, kinds: np.ndarray, n: int, percent: int) -> np.ndarray:
    """Keys of the blocks of a set of n shingles, of which others hold `held` (kinds: how common each is).

    Pairs meet in the class of the larger one, so a set has blocks in its own class and in the next.
    """
    edges = _edges(percent, n)
    own = int(np.searchsorted(edges, n, "right")) - 1
    budget = lambda both: (100 - percent) * both // (100 + percent)
    rare, largest, out = n - len(held), n * 100 // percent, []
    for c in (own, own + 1):
        if c > own and largest < edges[c]:
            break
        upper = edges[c + 1] - 1
        parts = (budget(2 * upper) * 5 + 3) // 4 + 1
        take = budget(n + min(upper, largest)) - rare + 1
        if take < 1:
            continue
        part = (mix(held ^ np.uint64(0x8CB92BA72F3D8DD7 + c)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        at = np.searchsorted(part[order], np.arange(parts))
        some = np.diff(np.append(at, len(part))) > 0
        mark, common = np.zeros(parts, np.uint64), np.full(parts, 255, np.int64)
        if some.any():
            mark[some] = np.add.reduceat(mix(held + np.uint64(0x2545F4914F6CDD1D))[order], at[some])
            common[some] = np.minimum.reduceat(kinds[order].astype(np.int64), at[some])
        mark = mix(mix(mark + np.arange(parts, dtype=np.uint64)) + np.uint64(c))
        out.append(mark[np.lexsort((mark, common))[:take]])
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _use_for(percent: int):
    def use(docs: list[Doc], state, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets, marks, slot = state
        rows: list[tuple] = []
        at, mark_at, seen = 0, sum(map(len, sets)), set()
        for d, s, (one, two) in zip(docs, sets, marks, strict=True):
            n = len(s)
            node = int(mix(np.array([one], np.uint64) + np.uint64(two)).view(np.int64)[0])
            doc = None if d.id == NULL_ID else d.id
            if not n:
                rows.append((0, doc, None, 0, False, None, *BARE))
                continue
            kinds = codes[slot[at : at + n]]
            at += n
            copies = int(codes[slot[mark_at]])
            mark_at += 1
            blocks = np.zeros(0, np.uint64)
            first = copies < 2 and node not in seen
            if first:
                seen.add(node)
                held = s[kinds > 0]
                if 100 * len(held) >= percent * n:
                    blocks = _blocks(held, kinds[kinds > 0], n, percent)
                if len(blocks):
                    rows.append((1, doc, node, n, True, blocks.view(np.int64), s.tobytes(), n - len(held), *_sketch(held)))
            rows.append((0, doc, node, n, bool(copies or len(blocks) or not first), None, *BARE))
        for a in range(0, len(rows), 512):
            cols = zip(*rows[a : a + 512], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, FIELDS, strict=True)], [n for n, _ in FIELDS])

    return use


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), True)) for a, b in zip(batch.column("sa"), batch.column("sb"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(both, pa.int32())], ["a", "b", "na", "nb", "both"])


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, d (distance), linked of distinct pairs (a < b) of nodes."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_overlaps, "a long, b long, na int, nb int, both int")
    union = F.col("na") + F.col("nb") - F.col("both")
    return both.select("a", "b", (1 - F.col("both") / union).alias("d"), (100 * F.col("both").cast("long") >= percent * union).alias("linked"))


#: What a row of a region has of its node, and of the pivot that it meets.
OF = ["node", "n", "rare", *LANES]
OF_PIVOT = {c: f"{c}_p" for c in OF}


def _apart() -> Column:
    """At least so many shingles are in one of a node and a pivot (columns with _p) only."""
    return sum((F.bit_count(F.col(g).bitwiseXOR(F.col(f"{g}_p"))) for g in LANES), F.col("rare") + F.col("rare_p"))


def _within(percent: int, times: int) -> Column:
    """Whether sizes and sketches of a node and a pivot let them be within `times` (1 or 2) the radius."""
    near = max(0, 100 - times * (100 - percent))  # the least similarity, in percent
    sizes = 100 * F.least("n", "n_p") >= near * F.greatest("n", "n_p")
    return sizes & ((100 + near) * _apart() <= (100 - near) * (F.col("n") + F.col("n_p")))


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document. Only components are computed: pairs already in one class aren't compared, so links are neither enumerated nor counted.

    A document's set holds its distinct shingles of `words` words (A-Z lower-cased, split at ASCII white space); of a shorter text, the whole
    sequence; of a null, empty or blank text, nothing, and it is linked with nothing. Two link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id reachable by links. Rows that repeat a doc_id are documents of their own; a null id joins
    components but names none (null where it is alone). Sets are compared by 64-bit hashes of their shingles, whole sets by 70 bits. The
    input must read the same each time; an empty table gives no rows; other columns aren't read.
    """
    spark = documents.sparkSession
    rows, n_units = units(documents, id_col, text_col)
    schema = "kind int, doc_id long, node long, n int, shared boolean, blocks array<long>, shingles binary, rare int, " + ", ".join(f"{g} long" for g in LANES)
    work = round_trip(rows, n_units, _asks_for(words), _answer, _use_for(percent), schema, LOAD, np.dtype(np.uint8), low_bits=32)
    found = staged(work, "jaccard")
    del rows, work
    release(spark)
    docs = found.where("kind = 0").select("doc_id", "node", "n", "shared")
    labels = _joined(found.where("kind = 1"), percent)
    tagged = staged(docs.where("shared").hint("merge").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).select("doc_id", "n", "root"), "classes")
    least = staged(tagged.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    joined = tagged.hint("merge").join(least, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = docs.where("not shared").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return alone.unionByName(joined)


def _joined(texts: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every node that has a link. texts: node, n, blocks, shingles, rare and sketch, one row per node.

    Two kinds of regions are open in a round. A plain one (region, node) asks for all links among its nodes; some of them become pivots, which
    meet all nodes of the region, and have a cell of what is at home with them. A cell (region, node, home, d) asks for links between its home and its boundary nodes only;
    boundary nodes become pivots and meet the home ones. d is the distance to the cell's pivot, of boundary nodes what it is at least: the
    window d(boundary) <= d(home) + radius then lets some more through, and none less. Nodes of one class needn't meet. A region without two classes is closed.
    """
    radius, scratch = 1 - percent / 100, Scratch(texts.sparkSession)
    staged = scratch.staged
    nodes = texts.select("node", "n", "shingles")
    held = texts.select("node", F.explode("blocks").alias("block"))
    leaders = staged(held.groupBy("block").agg(F.min("node").alias("p"), F.count("*").alias("m")).where("m > 1").select("block", "p"), "leaders")
    members = held.hint("merge").join(leaders, "block").select(F.col("p").alias("region"), "node").distinct()
    plain = staged(members.hint("merge").join(texts.select(*OF), "node").select("region", *OF), "plain")
    pivots = plain.where("node = region")
    cells = asking = labels = None
    distances: list[DataFrame] = []
    wide = 1
    while True:
        # plain regions: nodes meet their region's pivots where they can be within the radius
        ahead = staged(pivots.select("region", *[F.col(c).alias(n) for c, n in OF_PIVOT.items()]), "pivots")
        met = plain.select("region", *OF).hint("merge").join(ahead, "region").where((F.col("node") != F.col("node_p")) & _within(percent, 1))
        meet = staged(met.select("region", "node", "node_p", *_pair()), "meet")
        pairs = meet.select("a", "b")
        if cells is not None:  # cells: home nodes meet the pivots of the boundary within the windows
            close = F.col("d_p") <= F.col("d") + radius + 1e-9
            near = cells.where("home").hint("merge").join(asking, "region").where(close & (F.col("root") != F.col("root_p")) & _within(percent, 1))
            pairs = pairs.unionByName(near.select(*_pair()))
        pairs = pairs.distinct()
        for known in distances:
            pairs = pairs.hint("merge").join(known.select("a", "b"), ["a", "b"], "left_anti")
        distances.append(staged(_verified(pairs, nodes, percent), "distances"))
        known = reduce(DataFrame.unionByName, distances)
        if labels is None or not distances[-1].where("linked").isEmpty():  # classes grow, and close regions
            labels = components(known.where("linked").select("a", "b"))
            release(texts.sparkSession)
        # homes: the nearest linked pivot of each node
        rooted = lambda df: df.hint("merge").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))  # noqa: E731, B023
        plain = staged(rooted(plain.select("region", *OF)), "rooted")
        linked = meet.hint("merge").join(known.where("linked").select("a", "b", "d"), ["a", "b"])
        homes = staged(linked.groupBy("region", "node").agg(F.min(F.struct("d", "node_p")).alias("at")).select("region", "node", "at.d", "at.node_p"), "homes")
        # boundaries: only now, when the links of this round are known, and only for pivots with a home, from other classes, within the window of
        # the farthest home node; pivots have met their whole region and are no boundary
        others = staged(plain.hint("merge").join(ahead.select("region", F.col("node_p").alias("node")), ["region", "node"], "left_anti"), "others")
        reach = homes.groupBy("region", "node_p").agg(F.max("d").alias("reach"))
        owners = plain.select("region", F.col("node").alias("node_p"), F.col("root").alias("class"))
        centres = staged(ahead.hint("merge").join(reach, ["region", "node_p"]).hint("merge").join(owners, ["region", "node_p"]), "centres")
        apart = 2 * _apart() / (F.col("n") + F.col("n_p") + _apart())  # no distance is less
        window = (F.col("root") != F.col("class")) & _within(percent, 2) & (apart <= F.col("reach") + radius + 1e-9)
        edge = others.hint("merge").join(centres, "region").where(window).withColumn("home", F.lit(False)).withColumn("d", apart)
        cell = lambda df: df.select(F.xxhash64("region", "node_p").alias("region"), *OF, "home", "d", "root")
        new = cell(edge).unionByName(cell(plain.hint("merge").join(homes, ["region", "node"]).withColumn("home", F.lit(True))))
        rest = others.hint("merge").join(homes.select("region", "node"), ["region", "node"], "left_anti")
        if cells is not None:
            old = cells.select("region", *OF, "home", "d").hint("merge").join(asking.select("region", F.col("node_p").alias("node")), ["region", "node"], "left_anti")
            new = new.unionByName(rooted(old))
        cells, plain = _open_cells(new, radius, staged), _open_plain(rest, percent, staged)
        if cells.isEmpty() and plain.isEmpty():
            scratch.drop()
            return labels
        wide *= 64
        pivots = _drawn(plain, wide)
        asking = staged(_drawn(cells.where("not home"), wide).select("region", *[F.col(c).alias(n) for c, n in {**OF_PIVOT, "d": "d_p", "root": "root_p"}.items()]), "asking")


def _pair() -> tuple[Column, Column]:
    return F.least("node", "node_p").alias("a"), F.greatest("node", "node_p").alias("b")


def _open_cells(cells: DataFrame, radius: float, staged: Staged) -> DataFrame:
    """Cells that still ask, with m and first of their boundaries. Home nodes are of one class; boundary nodes of that class are done, as are
    those beyond the window of the farthest home node, and so is a cell without home or without boundary."""
    cells = staged(cells, "cells")
    of = cells.where("home").groupBy("region").agg(F.min("root").alias("class"), F.max("d").alias("reach"))
    asks = (F.col("root") != F.col("class")) & (F.col("d") <= F.col("reach") + radius + 1e-9)
    left = cells.hint("merge").join(of, "region").where(F.col("home") | asks).drop("class", "reach")
    edge = left.where("not home").groupBy("region").agg(F.count("*").alias("m"), F.min("node").alias("first"))
    return staged(left.hint("merge").join(edge, "region"), "cells")


def _open_plain(rows: DataFrame, percent: int, staged: Staged) -> DataFrame:
    """Plain regions of two classes, with m and first, less nodes that hold so much of their own that no node of the region is within the threshold."""
    spare = ((100 + percent) * F.col("rare") - (100 - percent) * F.col("n")).cast("long")  # two can be linked if theirs add up to 0 at most
    rows = staged(rows.withColumn("spare", spare), "rest")
    of = rows.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("spare").alias("least"), F.count("*").alias("m"), F.min_by("node", F.struct("spare", "node")).alias("first"))
    return staged(rows.hint("merge").join(of.where("lo <> hi and least <= 0"), "region").where(F.col("spare") + F.col("least") <= 0).select("region", *OF, "m", "first"), "plain")


def _drawn(rows: DataFrame, wide: int) -> DataFrame:
    """About `wide` nodes of each region, by a threshold of the hash that a node is, and the first: no region is sorted."""
    return rows.where(((F.col("node") / 2.0**64 + 0.5) * F.col("m") < wide) | (F.col("node") == F.col("first")))
