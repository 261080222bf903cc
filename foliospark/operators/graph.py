"""Connected components of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for the nodes of edges (a, b) of longs; root is the least node linked with a node.

    A round sends each node's larger neighbours, then its smaller ones, to its least neighbour; the rounds needed grow as the
    logarithm of the longest path. Minima are pre-aggregated, so a node with very many edges is no bottleneck, and every round is
    written, so a lost executor costs no more than one. Loops are ignored.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        now = materialize(large.join(least, "a").select(ends.alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        mark = seen
    raise RuntimeError(f"the components took more than {rounds} rounds")
