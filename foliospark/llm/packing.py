"""Best-fit decreasing packing of token sequences, exact for any number of documents.

Pieces of one length are interchangeable, and so are bins with one remaining capacity. So the packing runs over the histogram of
lengths, at most ``capacity`` numbers, and places whole runs of equal pieces into whole runs of equal bins: the steps are those of
best-fit decreasing over all pieces, taken many at a time. The outcome is a plan from (length, rank among pieces of that
length) to (sequence, offset); ranks come from counts by partition, so that no task and no driver ever holds the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, narrow, shared_dir, slices, starts
from .wordbpe import load

#: A plan of no more steps than this is sent to every executor; a longer one is joined by shuffling.
BROADCAST_STEPS = 100_000


class OpenBins:
    """Open bins by remaining capacity, as runs of numbers, under a segment tree that tells which capacities have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.any = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, value: int) -> None:
        at = self.leaves + room
        self.any[at] = value
        while at > 1:
            at >>= 1
            new = self.any[2 * at] | self.any[2 * at + 1]
            if self.any[at] == new:
                break
            self.any[at] = new

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            if len(self.runs[room]) == 1:
                self._mark(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return run

    def tightest(self, size: int) -> int | None:
        """The least capacity of an open bin that is at least ``size``."""
        at = self.leaves + size
        if self.any[at]:
            return size
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, first rank, pieces per bin, bins, first bin, offset) and the number of bins."""
    bins, used, plan = OpenBins(capacity), 0, []
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = bins.tightest(size)
            if room is None:
                room = capacity
                first, count = used, -(-left // (capacity // size))
                used += count
            else:
                first, count = bins.take(room)
            each = room // size
            full = min(count, left // each)
            if full:
                plan.append((size, rank, each, full, first, capacity - room))
                bins.add(room - each * size, first, full)
                rank, left, first, count = rank + each * full, left - each * full, first + full, count - full
            if left and count:
                plan.append((size, rank, left, 1, first, capacity - room))
                bins.add(room - left * size, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            bins.add(room, first, count)
    return plan, used


def cut(df: DataFrame, tokenizer: str, end: int, capacity: int, key: str, text: str, with_ids: bool) -> DataFrame:
    """Every row's ids in pieces of at most ``capacity``, with each piece's rank among those of its length in its partition."""
    source = narrow(df, key=key, text=text)
    schema = T.StructType(
        [
            T.StructField(key, source.schema["key"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("_part", T.IntegerType()),
            T.StructField("_nth", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, part = load(tokenizer), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for batch in slices(batches):
            ids, n = bpe.encode(batch.column(1), end)
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - starts(pieces)[:-1][doc]
            begin = piece * capacity
            length = np.minimum(capacity, n[doc] - begin)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
            runs = np.diff(np.append(heads, len(ordered)))
            nth = np.empty(len(length), dtype=np.int64)
            nth[order] = seen[ordered] + np.arange(len(ordered)) - np.repeat(heads, runs)
            seen += np.bincount(length, minlength=capacity + 1)
            raw = memoryview(ids.tobytes())
            at = (starts(length) * 4).tolist()
            columns = [
                batch.column(0).take(pa.array(doc)),
                pa.array(piece.astype(np.int32)),
                pa.array(begin),
                pa.array(length),
                pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                pa.array(np.full(len(doc), part, dtype=np.int32)),
                pa.array(nth),
            ]
            if with_ids:
                columns.append(pa.array([bytes(raw[a:b]) for a, b in zip(at, at[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def pack(
    df: DataFrame, tokenizer: str, end: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if asked for.

    A null or empty text is one piece that holds only the end id. Rows with equal or null keys are packed as separate
    documents. An empty table gives no rows. The texts are encoded once; what is shuffled after that are seven numbers a piece.
    """
    spark = df.sparkSession
    pieces = materialize(cut(df, tokenizer, end, capacity, key, text, with_ids), shared_dir(spark))
    counts = pieces.groupBy("length", "_part").count()
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    steps, _ = best_fit(histogram, capacity)
    rows = pa.table(
        {
            name: pa.array([s[i] for s in steps], pa.int64())
            for i, name in enumerate(("length", "_first", "_each", "_bins", "_bin", "_offset"))
        }
    )
    plan = spark.createDataFrame(rows) if len(steps) else spark.createDataFrame([], "length long, _first long, _each long, _bins long, _bin long, _offset long")
    plan = plan.withColumn("_last", F.expr("_first + _each * _bins"))
    if len(steps) <= BROADCAST_STEPS:
        plan = F.broadcast(plan)
    p = pieces.join(base, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_nth"))
    at = F.col("_rank") - F.col("_first")
    return p.join(plan, (p["length"] == plan["length"]) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))).select(
        key,
        "piece",
        "start",
        p["length"],
        "ids_crc32",
        (F.col("_bin") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_each")) * p["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of a packing with ids: sequence_id, ``ids`` as bytes, and the offsets at which documents begin."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id",
        F.expr("aggregate(p, cast('' as binary), (acc, x) -> concat(acc, x.ids))").alias("ids"),
        F.expr("transform(p, x -> x.offset)").alias("offsets"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
