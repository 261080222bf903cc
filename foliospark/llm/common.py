"""What the operators of this subpackage share: word tables, batches of bounded size, the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are turned into words at once, and of an Arrow batch. Arrays over words take some fifteen times that.
SLICE_BYTES = BATCH_BYTES = 8 << 20
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder of its own under the folder that all executors share.

    The session names it in ``spark.checkpoint.dir``. Only where that is unset (tests, one machine) a
    temporary folder is made, and removed at exit.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="foliospark-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write the rows to Parquet and read them back: their lineage ends here and no lost executor matters."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])
    return fs.LocalFileSystem(), uri


def drop_dir(uri: str) -> None:
    """Remove a folder of intermediate files, if it is there."""
    system, path = file_system(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash with results.

    Bounds the bytes of Arrow batches too.
    """
    bound_batches(df.sparkSession)
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library: it keeps what it likes
        return lambda _: 0


def release() -> None:
    """Give freed memory back to the system: workers are reused, and two share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, those that hold more bytes cut into parts of about that size."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        parts = min(n, -(-batch.nbytes // size))
        step = -(-n // parts)
        for at in range(0, n, step):
            yield batch.slice(at, step)
            release()


def array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of plain strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.string()) if column.type != pa.string() else column


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of the lists, and where each list's values start; a null list has none."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), starts(n)


def starts(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the values of each part; at: where each part starts, and the end."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Words:
    """The words of some texts, cut at the six ASCII white space characters, as numbers of distinct words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = array(texts)
        if lower:
            texts = pc.ascii_lower(texts)
        values, at = flat(pc.ascii_split_whitespace(texts))
        if len(values):
            coded = values.dictionary_encode()
            self.vocab, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            blank = pc.index(self.vocab, "").as_py()
            if blank >= 0:
                keep = codes != blank
                at = starts(sums(keep.astype(np.int64), at))
                codes = codes[keep]
                codes = codes - (codes > blank)
                self.vocab = self.vocab.filter(pa.array(np.arange(len(self.vocab)) != blank))
        else:
            self.vocab, codes = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.codes, self.at = codes.astype(np.int64), at

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def docs(self) -> np.ndarray:
        """The number of the text that each word is in."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, vocab.to_pylist()), dtype=np.uint64, count=len(vocab))


def text_bytes(df: DataFrame, text: str) -> int:
    """The bytes of all texts: what numbers of ranges, buckets and shards follow from, whatever the session's settings are."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def by_number(df: DataFrame, column: str, count: int, merge, schema: str) -> DataFrame:
    """What ``merge`` makes of all rows with one number in ``column``, from 0 to count - 1: each number has a task of its own, so none is read with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            yield from merge(pa.Table.from_batches(own)).to_batches()

    return df.repartitionById(count, F.col(column).cast("int")).mapInArrow(run, schema)


_SEEDS = np.array([0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


class Filter:
    """A Bloom filter of 64-bit ids, of ``each`` bits an id and never more than ``most`` bits: with very many ids it lets more through, which costs
    shuffling but changes no result. Each of its slices is made by one task."""

    SLICE = 1 << 20  # bits

    def __init__(self, ids: DataFrame, count: int, most: int = 1 << 27, each: int = 12):
        self.probes = max(1, each // 3)
        size = min(most, 1 << max(13, (each * count).bit_length()))
        positions, width = self.positions, min(self.SLICE, size)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(positions(batch.column(0).to_numpy(zero_copy_only=False), size))
                cuts = np.searchsorted(at, np.arange(0, size + width, width)).tolist()
                rows = [(i, (at[a:b] - i * width).astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["slice", "at"])

        def mark(table: pa.Table) -> pa.Table:
            bits = np.zeros(width, dtype=bool)
            for at in table.column("at"):
                bits[np.frombuffer(at.as_py(), dtype="<u4")] = True
            return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        self.bits = np.zeros(size // 8, dtype=np.uint8)
        for row in ids.mapInArrow(cut, "slice int, at binary").groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect():
            self.bits[row["slice"] * width // 8 :][: width // 8] = np.frombuffer(row["bits"], dtype=np.uint8)

    def positions(self, ids: np.ndarray, size: int) -> np.ndarray:
        a = mix(ids.view(np.uint64) ^ _SEEDS[0])
        b = mix(a ^ _SEEDS[1]) | np.uint64(1)
        return ((a[:, None] + np.arange(self.probes, dtype=np.uint64) * b[:, None]) % np.uint64(size)).astype(np.int64)

    def has(self, ids: np.ndarray) -> np.ndarray:
        at = self.positions(ids, 8 * len(self.bits))
        return ((self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
