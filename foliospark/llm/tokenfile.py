"""Token ids in binary shards, each with a minimal perfect hash index from document key to place."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_system, materialize, mix, narrow, shared_dir, slices, starts, text_bytes
from .wordbpe import load

MAGIC, VERSION = b"FOLIOTOK", 2
#: Bytes of text for each shard.
SHARD_BYTES = 64 << 20
#: magic, version, bytes an id, rows, rows with a null key, ids, distinct keys, levels, leftover keys
HEADER = struct.Struct("<8sIIQQQQII")
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """A minimal perfect hash of 64-bit keys: levels of bits, where a key owns the bit that no other key of its level hits.

    A key's number is the rank of its bit. Two bits a key and level keep the expected number of levels looked at
    below two, whatever the number of keys. Keys still unplaced after the last level are listed and searched.
    """

    BLOCK = 512

    def __init__(self, words: list, sizes: list[int], ranks: list, left: np.ndarray, placed: int):
        """words: each level's bits, 64 in one; ranks: how many bits are set before each block of BLOCK, lower levels included; placed: all."""
        self.words, self.sizes, self.ranks, self.left, self.placed = words, sizes, ranks, left, placed

    @classmethod
    def build(cls, keys: np.ndarray, levels: int = 40) -> PerfectHash:
        """From distinct keys."""
        bits, sizes, ranks, placed, rest = [], [], [], 0, keys.astype(np.uint64)
        while len(rest) and len(bits) < levels:
            size = 2 * len(rest) + 1
            at = (mix(rest ^ _SEEDS[len(bits)]) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            flags = np.zeros(-(-size // cls.BLOCK) * cls.BLOCK, dtype=np.uint8)
            flags[at[alone]] = 1
            bits.append(np.packbits(flags, bitorder="little").view(np.uint64))
            sizes.append(size)
            per = np.bitwise_count(bits[-1]).reshape(-1, cls.BLOCK // 64).sum(axis=1).astype(np.int64)
            ranks.append(placed + starts(per)[:-1])
            placed += int(per.sum())
            rest = rest[~alone]
        return cls(bits, sizes, ranks, np.sort(rest), placed)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A number below the number of keys; any number, or -1, for a key that wasn't there when it was built."""
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (words, size, ranks) in enumerate(zip(self.words, self.sizes, self.ranks)):
            if not len(todo):
                return out
            at = (mix(keys[todo] ^ _SEEDS[level]) % np.uint64(size)).astype(np.int64)
            own = words[at >> 6]
            hit = (own >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            p = at[hit]
            block = p // self.BLOCK
            n = ranks[block]
            for k in range(self.BLOCK // 64 - 1):
                w = block * (self.BLOCK // 64) + k
                before = np.flatnonzero(w < p >> 6)
                n[before] += np.bitwise_count(words[w[before]]).astype(np.int64)
            below = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
            n = n + np.bitwise_count(own[hit] & below).astype(np.int64)
            out[todo[hit]] = n
            todo = todo[~hit]
        if len(todo) and len(self.left):
            i = np.minimum(np.searchsorted(self.left, keys[todo]), len(self.left) - 1)
            found = self.left[i] == keys[todo]
            out[todo[found]] = self.placed + i[found]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class ShardWriter:
    """Streams ids to a file; the index follows them when it is closed. Rows come in ascending key order, null keys first."""

    def __init__(self, uri: str, width: int):
        self.system, self.path = file_system(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.width = self.system.open_output_stream(self.path), width
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls = 0

    def append(self, keys: pa.Array, payloads: pa.Array) -> None:
        self.nulls += keys.null_count
        self.keys.append(keys.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        raw = payloads.to_pylist()
        self.counts.append(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // self.width)
        self.out.write(b"".join(raw))

    def close(self) -> tuple[int, int]:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        at = starts(np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64))
        distinct, first, rows = np.unique(keys, return_index=True, return_counts=True)
        table = PerfectHash.build(distinct.view(np.uint64))
        slot = table.slots(distinct)
        prints = np.empty(len(distinct), dtype="<u4")
        place = np.empty((len(distinct), 2), dtype="<i8")
        prints[slot] = fingerprints(distinct)
        place[slot, 0], place[slot, 1] = first + self.nulls, rows
        self.out.write(bytes(-self.out.tell() % 8))
        begin = self.out.tell()
        levels = np.array([[size, len(w)] for size, w in zip(table.sizes, table.words)], dtype="<u8")
        for part in (levels, table.left.astype("<u8"), at.astype("<i8"), keys.astype("<i8"), place, *table.words, *[r.astype("<i8") for r in table.ranks], prints):
            self.out.write(part.tobytes())
        head = HEADER.pack(MAGIC, VERSION, self.width, len(at) - 1, self.nulls, int(at[-1]), len(distinct), len(table.words), len(table.left))
        self.out.write(head + struct.pack("<QI", begin, zlib.crc32(head)))
        self.out.close()
        return len(at) - 1, int(at[-1])


class Stored:
    """Numbers in a file, each read when it is asked for."""

    def __init__(self, file, begin: int, dtype: str, count: int):
        self.file, self.begin, self.dtype, self.count = file, begin, np.dtype(dtype), count

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i):
        size = self.dtype.itemsize
        if isinstance(i, slice):
            a, b, _ = i.indices(self.count)
            return np.frombuffer(self.file.read_at(size * max(0, b - a), self.begin + size * a), dtype=self.dtype)
        places = np.atleast_1d(i)
        out = np.array([np.frombuffer(self.file.read_at(size, self.begin + size * x), dtype=self.dtype)[0] for x in places.tolist()], dtype=self.dtype)
        return out if np.ndim(i) else out[0]


class Shard:
    """A shard file, memory-mapped where the file system can. Opening reads the end and a line for each level; a key then costs a few small reads, and
    its ids one, however large the shard is."""

    def __init__(self, uri: str):
        system, path = file_system(uri)
        local = system.type_name == "local"
        self.file = pa.memory_map(path) if local else system.open_input_file(path)
        end, tail = self.file.size(), HEADER.size + 12
        raw = self.file.read_at(tail, end - tail)
        begin, check = struct.unpack("<QI", raw[HEADER.size :])
        magic, version, self.width, rows, self.nulls, self.n_ids, n, levels, left = HEADER.unpack(raw[: HEADER.size])
        if magic != MAGIC or version != VERSION or zlib.crc32(raw[: HEADER.size]) != check:
            raise ValueError(f"{uri} is no token file of version {VERSION}")
        at = begin

        def take(dtype: str, count: int):
            nonlocal at
            own = Stored(self.file, at, dtype, count)
            at += count * own.dtype.itemsize
            return own[:] if local else own

        table = take("<u8", 2 * levels)[:].reshape(-1, 2).astype(np.int64)
        rest = take("<u8", left)[:]
        self.rows, self.at, self.keys, self.place = rows, take("<i8", rows + 1), take("<i8", rows - self.nulls), take("<i8", 2 * n)
        words = [take("<u8", int(k)) for _, k in table]
        ranks = [take("<i8", int(k) * 64 // PerfectHash.BLOCK) for _, k in table]
        self.table = PerfectHash(words, table[:, 0].tolist(), ranks, rest, n - left)
        self.prints = take("<u4", n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row of each key and how many rows it has; no rows for a key whose fingerprint isn't there, or whose row has another key."""
        keys = np.asarray(keys, dtype=np.int64)
        slot = self.table.slots(keys.view(np.uint64))
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        first, rows = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        at, n = self.place[2 * slot[known]], self.place[2 * slot[known] + 1]
        right = self.keys[at - self.nulls] == keys[known]
        known = np.flatnonzero(known)[right]
        first[known], rows[known] = at[right], n[right]
        return first, rows

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.at[row]), int(self.at[row + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), dtype=f"<u{self.width}")

    def __getitem__(self, key: int) -> list[np.ndarray]:
        """The ids of every row with the key, in constant time whatever the shard holds."""
        first, rows = self.find(np.array([key]))
        return [self.ids(int(first[0]) + k) for k in range(int(rows[0]))]


MANIFEST = "shard int, path string, min_key long, max_key long, n_docs long, n_ids long"


def write(df: DataFrame, tokenizer: str, folder: str, end: int = 1, shards: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write the shards; gives the manifest: a row for each shard, in key order.

    There is a shard for each SHARD_BYTES of text, or ``shards``. Keys are integers; null ones come first, rows with one key follow each other in the order of their ids' checksum. Limits between
    shards are quantiles of the keys; where one key spans several limits its rows are spread over those shards by checksum, so that a hot key
    doesn't end in one file. A null text counts as empty. An empty table gives no shards. Texts are encoded before
    the only shuffle, which moves two or four bytes an id. A file's name is new in each attempt, and only the manifest makes it count.
    """
    spark = df.sparkSession
    count = shards or max(1, -(-text_bytes(df, text) // SHARD_BYTES))
    quantiles = [i / count for i in range(1, count)]
    found = df.select(F.col(key).cast("double").alias("k")).stat.approxQuantile("k", quantiles, 0.1 / count) if quantiles else []
    limits = np.array([int(max(-(2.0**63), min(x, 2.0**63 - 1024))) for x in found], dtype=np.int64)
    source = narrow(df, key=key, text=text)
    encoded = T.StructType([T.StructField("key", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("shard", "tie")], T.StructField("ids", T.BinaryType())])
    width = 2 if max(load(tokenizer).tokenizer.get_vocab_size() - 1, end) < 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in slices(batches):
            ids, n = bpe.encode(batch.column(1), end)
            keys = batch.column(0).cast(pa.int64())
            raw, at = ids.astype(f"<u{width}").tobytes(), (starts(n) * width).tolist()
            payload = [raw[a:b] for a, b in zip(at, at[1:])]
            tie = np.fromiter(map(zlib.crc32, payload), dtype=np.int64, count=len(payload))
            k = keys.fill_null(0).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(limits, k, "left"), np.searchsorted(limits, k, "right")
            shard = np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, low + (tie * (high - low + 1) >> 32))
            yield pa.RecordBatch.from_arrays([keys, pa.array(shard), pa.array(tie), pa.array(payload, pa.binary())], names=encoded.names)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = low = high = shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            if writer is None:
                shard = batch.column(1)[0].as_py()
                path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
                writer = ShardWriter(path, width)
            real = keys.drop_null()
            if len(real):
                low, high = real[0].as_py() if low is None else low, real[-1].as_py()
            writer.append(keys, batch.column(3))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "path": path, "min_key": low, "max_key": high, "n_docs": n_docs, "n_ids": n_ids}],
                pa.schema([("shard", pa.int32()), ("path", pa.string()), *[(c, pa.int64()) for c in ("min_key", "max_key", "n_docs", "n_ids")]]),
            )

    placed = source.mapInArrow(encode, encoded).repartitionById(count, F.col("shard").cast("int")).sortWithinPartitions("key", "tie")
    return materialize(placed.mapInArrow(store, MANIFEST), f"{folder}/manifest").orderBy("shard")


ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, row long"


def read(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: key, ids before it, number of ids and their checksum as 32-bit ids.

    Each key is looked up in its shard's index, and the row that the index names is the one that is read. The manifest, one row a shard,
    is all that the driver sees.
    """
    spark, base, tasks = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").collect():
        tasks.append((r["shard"], r["path"], base))
        base += r["n_ids"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, before in zip(*[c.to_pylist() for c in batch.columns]):
                shard = Shard(path)
                stored, ends = shard.keys[:], shard.at[:]
                distinct = np.unique(stored)
                first, rows = shard.find(distinct)
                if int(rows.sum()) + shard.nulls != shard.rows:
                    raise ValueError(f"the index of {path} misses keys")
                row = np.concatenate([np.arange(shard.nulls), np.repeat(first - starts(rows)[:-1], rows) + np.arange(int(rows.sum()))])
                for at in range(0, len(row), 20_000):
                    r = row[at : at + 20_000]
                    keys = [None if x < shard.nulls else int(stored[x - shard.nulls]) for x in r]
                    crc = [zlib.crc32(shard.ids(x).astype("<u4").tobytes()) for x in r]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64()),
                            pa.array(before + ends[r]),
                            pa.array(ends[r + 1] - ends[r]),
                            pa.array(crc, pa.int64()),
                            pa.array(np.full(len(r), number, dtype=np.int32)),
                            pa.array(r),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "row"],
                    )

    if not tasks:
        return spark.createDataFrame([], ROWS)
    files = spark.createDataFrame(tasks, "shard int, path string, before long")
    return files.repartitionById(len(tasks), F.pmod(F.col("shard"), F.lit(len(tasks))).cast("int")).mapInArrow(scan, ROWS)


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of the given keys: a row (key, ids) for each stored row of each distinct key; unknown and null keys give none.

    Keys go to the shards whose range holds them, and each is found there in constant time. The manifest is small: a row a
    shard. Keys are shuffled by shard.
    """
    bounds = F.broadcast(manifest.select("path", "min_key", "max_key"))
    wanted = keys.select(F.col(key).cast("long").alias("key")).distinct()
    routed = wanted.join(bounds, (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))).select("path", "key")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            found = []
            for p, k in zip(*[c.to_pylist() for c in batch.columns]):
                if p != path:
                    path, shard = p, Shard(p)
                found += [(k, ids.tolist()) for ids in shard[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["key", "ids"]
            )

    return routed.repartition("path", F.pmod(F.hash("key"), F.lit(16))).sortWithinPartitions("path").mapInArrow(fetch, "key long, ids array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(documents, public_tokenizers.path("word_bpe_49k.json"), shared_dir(spark))).select("doc_id", "start", "n_tokens", "ids_crc32")
