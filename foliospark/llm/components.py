"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_dir, materialize, shared_dir


def components(edges: DataFrame, path: str | None = None, rounds: int = 60) -> DataFrame:
    """A row (node, root) for every node of an edge (a, b) of longs; root is the least node that it is linked with.

    Each round links every node's larger neighbours, then its smaller ones, to its least neighbour, which halves paths: the rounds
    needed grow as the logarithm of the diameter. Rounds are cut by written tables, so a lost executor costs one round. Minima
    are pre-aggregated before the shuffle, so that a node with many edges is no bottleneck. The rows are written to ``path``, a new folder if there is none. No edges, no rows; loops are ignored.
    """
    spark, folder = edges.sparkSession, shared_dir(edges.sparkSession)
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    mark = None
    for i in range(1, rounds + 1):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        new = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), f"{folder}/{i}")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_dir(f"{folder}/{i - 1}")
        now = new
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"the components took more than {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    found = materialize(now.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), path or f"{shared_dir(spark)}/roots")
    drop_dir(folder)
    return found
