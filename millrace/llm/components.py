"""Connected components by contraction, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_staged, staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge; root is the same throughout a component and is one of its nodes.

    Each round hooks every node to its least neighbour and contracts the edges; ids should be in random order (hashes), which makes the
    number of rounds logarithmic. Rows with a null end and loops count as no edge. What a round needs is written to the shared folder.
    """
    start = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    left = staged(start, "edges")
    roots = staged(left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("root")), "roots")
    while left.limit(1).count():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("to")), "hooks")
        step = lambda df, col: df.hint("merge").join(hook.select(F.col("a").alias("__a"), "to"), F.col(col) == F.col("__a"), "left").withColumn(col, F.coalesce("to", col)).drop("__a", "to")  # noqa: E731, B023
        old_left, old_roots = left, roots
        left = staged(step(step(left, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        roots = staged(step(roots, "root"), "roots")
        for used in (old_left, old_roots, hook):
            drop_staged(used)
    return roots
