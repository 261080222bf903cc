"""Running numbers over a whole table, batches, and how many processes a run may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Gigabytes that one process of the models needs, and what a machine without a GPU is taken to have.
PROCESS_GB, DEFAULT_GB = 7.8, 8.0


def running_index(df: DataFrame, order: list[Column | str], name: str = "page_idx") -> DataFrame:
    """``df`` with a 0-based number in the given order over all rows; give an order without ties.

    Rows are sorted by range, numbered within their partitions, and the partitions' sizes added up: no task sees more than
    its range, and only one number for each partition is broadcast. The sorted rows are written once, so that both steps see the same partitions.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    rows = materialize(placed.withColumn("_part", F.shiftright(local, 33)).withColumn("_nth", local.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def batch_of(index: Column, size: int) -> Column:
    """The number of the batch of ``size`` that an index is in."""
    return F.floor(index / size).cast("long")


def batch_size(n: Column, requested: Column, workers: Column, gigabytes: Column) -> Column:
    """The least batch size from the requested one on with which neither workers nor memory run out; at most one batch if neither is enough for any."""
    at_once = F.least(workers.cast("long"), F.floor(gigabytes / PROCESS_GB).cast("long"))
    asked = F.greatest(requested, F.lit(1)).cast("long")
    fits = F.ceil(n / asked) <= at_once
    return F.when(fits, asked).when(at_once <= 0, F.greatest(asked, n.cast("long"))).otherwise(F.greatest(asked, F.ceil(n / F.greatest(at_once, F.lit(1))).cast("long")))


def plan(df: DataFrame, parallel: bool = True) -> DataFrame:
    """``df`` (n, requested, workers, gb, anything else) with batch_size, processes and whether they run in parallel.

    Without pages the batch size is the requested one, and one process still runs.
    """
    sized = df.withColumn("batch_size", batch_size(F.col("n"), F.col("requested"), F.col("workers"), F.col("gb")))
    counted = sized.withColumn("processes", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("batch_size"))).cast("long"))
    return counted.withColumn("in_parallel", F.lit(parallel) & (F.col("processes") > 1))


def resources(df: DataFrame) -> tuple[int, float]:
    """Workers and gigabytes of a run without a GPU: one core stays free."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism - 1), DEFAULT_GB
