"""Exact Jaccard self-join of shingle sets: identical sets are classes, classes with equal prefix and size are groups,
pairs of groups are filtered by shared prefix tokens and sizes, and only members of the pairs left are verified.

1. One pass over the texts. Every document's set gets a 64-bit class id. Of its tokens in hash order the first ``0.3 n`` are
   enough: two documents that link share at least ``0.1 n`` of them. Those tokens go, packed by range of the hash, to where
   it is seen which of them another class has too. Classes with too few such tokens can't link and are done.
2. A second pass over the texts gives the whole sets of the other classes; a Bloom filter of those classes, of bounded size, decides which
   sets leave their task, so that no text is shuffled. The sets are written in packs, and a pack asks once for each of its tokens how many
   sets have it. Now tokens are ordered rarest first, so that passages which many documents share come last. What is left links through its
   prefix of ``0.2 n + 1`` tokens.
3. Groups that share prefix tokens form components. Small components are compared whole, many in a task. A large one is cut into blocks by size
   and hash, and a set goes only to blocks of about its size where another set shares one of its prefix tokens. In each task groups are paired by
   inverted lists, and the members of those pairs are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Filter, Words, by_number, drop_dir, materialize, mix, narrow, release, shared_dir, slices, starts, text_bytes, word_hashes
from .components import components

#: Members of a block; two blocks are compared in a task. Bytes of text, and tokens of sets, for each bucket of postings.
BLOCK, BUCKET_BYTES, BUCKET_TOKENS = 768, 16 << 20, 1_000_000
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct shingles as sorted 64-bit hashes, one text after the other, and where each begins.

    Words are lower-cased (A-Z). A text of fewer words than ``size`` has one shingle, all its words; one without words, or null, none.
    """
    words = Words(texts, lower=True)
    n, rows = words.counts, len(words.at) - 1
    h = word_hashes(words.vocab)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    consts = mix(np.arange(1, size + 1, dtype=np.uint64) * _C[0])
    lists = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    at = starts(lists)
    doc = np.repeat(np.arange(rows), lists)
    begin = words.at[:-1][doc] + np.arange(len(doc)) - at[:-1][doc]
    sums = np.zeros(len(doc), dtype=np.uint64)
    short = n[doc] < size
    for k in range(size):
        inside = ~short | (k < n[doc])
        i = begin[inside] + k
        sums[inside] += mix(h[i] + consts[k])
    sums = mix(sums ^ np.where(short, n[doc], size).astype(np.uint64))
    order = np.lexsort((sums, doc))
    sums = sums[order]
    keep = np.ones(len(sums), dtype=bool)
    keep[1:] = (sums[1:] != sums[:-1]) | (doc[1:] != doc[:-1])
    return sums[keep], starts(np.bincount(doc[keep], minlength=rows))


def class_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set; equal sets, equal ids."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ _C[1]), dtype=np.uint64)])
    return mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(np.uint64) * _C[2]).view(np.int64)


class Threshold:
    """Two sets link if 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def need(self, n: np.ndarray) -> np.ndarray:
        """The least intersection of a set of that size with any set that it links with."""
        return -(-self.percent * n // 100)

    def extra(self, n: np.ndarray) -> np.ndarray:
        return -(-n // 10)

    def sample(self, n: np.ndarray) -> np.ndarray:
        """How many tokens, in hash order, are looked at in the first pass."""
        return np.where(n == 0, 0, np.minimum(n, n - self.need(n) + self.extra(n)))

    def least(self, n: np.ndarray) -> np.ndarray:
        """How many of those a partner, whose size is at least ``need(n)``, must have too."""
        return np.maximum(1, self.extra(self.need(n)))

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (both > 0) & (100 * both >= self.percent * (a + b - both))


def _postings(tokens: np.ndarray, owner: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Tokens and owners by bucket, that is by range of the tokens."""
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, tokens[cuts[b] : cuts[b + 1]], owner[cuts[b] : cuts[b + 1]]


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    return first, np.diff(np.append(first, len(tokens)))


_SHARED = np.int64(0)  # the owner that stands for "two classes of one batch have it"


def documents_and_shared(df: DataFrame, size: int, threshold: Threshold, buckets: int) -> DataFrame:
    """Rows (key, n, class) of all documents, and rows (class, shared): how many sampled tokens of a class others have.

    Within a batch, equal sets count once, and a token that several classes have is sent once and counted on the spot. So what arrives
    for the most frequent token grows with the number of batches, not of documents.
    """
    schema = "bucket int, tokens binary, owners binary, keys array<long>, ns array<long>, classes array<long>, shared array<long>"
    result = "key long, n long, class long, shared long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, at = shingle_sets(batch.column(1), size)
            n, ids = np.diff(at), class_ids(tokens, at)
            _, one = np.unique(ids, return_index=True)
            one = one[n[one] > 0]
            take = threshold.sample(n)[one]
            index = np.repeat(at[one] - starts(take)[:-1], take) + np.arange(int(take.sum()))
            t, o = tokens[index], ids[np.repeat(one, take)]
            order = np.argsort(t, kind="stable")
            t, o = t[order], o[order]
            first, count = _runs(t)
            several = np.repeat(count > 1, count)
            local, hits = np.unique(o[several], return_counts=True)
            shared = np.zeros(len(n), dtype=np.int64)
            i = np.searchsorted(local, ids[one]) if len(local) else np.zeros(len(one), np.int64)
            if len(local):
                i = np.minimum(i, len(local) - 1)
                shared[one] = np.where(local[i] == ids[one], hits[i], 0)
            o = np.where(count > 1, _SHARED, o[first])
            rows = [(b, x.tobytes(), y.tobytes(), None, None, None, None) for b, x, y in _postings(t[first], o, buckets)]
            keys = batch.column(0).cast(pa.int64()).to_pylist()
            rows.append((int(ids[0] % buckets), None, None, keys, n.tolist(), ids.tolist(), shared.tolist()))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), longs, longs, longs, longs))],
                names=["bucket", "tokens", "owners", "keys", "ns", "classes", "shared"],
            )

    def count(table: pa.Table) -> pa.Table:
        t, o = _joined(table, "tokens", np.uint64), _joined(table, "owners", np.int64)
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        first, n = _runs(t)
        # a token is shared if two classes, or the mark, are there for it; no class id sorts between the mark and itself
        many = o[first] != o[first + n - 1]
        many |= np.maximum.reduceat(o == _SHARED, first) if len(first) else False
        marked = np.repeat(many, n) & (o != _SHARED)
        same = np.ones(len(t), dtype=bool)
        same[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        owners, hits = np.unique(o[marked & same], return_counts=True)
        keys, ns, classes, shared = ([x for part in table.column(c).to_pylist() if part is not None for x in part] for c in ("keys", "ns", "classes", "shared"))
        k = len(keys)
        del t, o, first, n, many, marked, same
        release()
        longs = lambda x: pa.array(x, pa.int64())
        return pa.table(
            {
                "key": longs(keys + [None] * len(owners)),
                "n": longs(ns + [None] * len(owners)),
                "class": longs(classes + owners.tolist()),
                "shared": longs(shared[:k] + hits.tolist()),
            }
        )

    return by_number(narrow(df, key="key", text="text").mapInArrow(cut, schema), "bucket", buckets, count, result)


def _joined(table: pa.Table, column: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(column).to_pylist() if x is not None), dtype=dtype)


def whole_sets(df: DataFrame, size: int, wanted: Filter) -> DataFrame:
    """Rows (class, n, tokens) of the texts whose class passes the filter, a class once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, at = shingle_sets(batch.column(0), size)
            ids, one = np.unique(class_ids(tokens, at), return_index=True)
            one = one[wanted.has(ids) & (np.diff(at)[one] > 0)]
            ends = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(class_ids(tokens, at)[one]),
                    pa.array(np.diff(at)[one]),
                    pa.array([tokens[ends[i] : ends[i + 1]].tobytes() for i in one.tolist()], pa.binary()),
                ],
                names=["class", "n", "tokens"],
            )

    return narrow(df, text="text").mapInArrow(run, "class long, n long, tokens binary")


def packs(sets: DataFrame) -> DataFrame:
    """The sets, several in a row: (pack, classes, ns, tokens), of about BATCH_BYTES each. A pack's number is good once its row is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(slices(batches, BATCH_BYTES)):
            row = (first + i, batch.column(0).to_numpy().tobytes(), batch.column(1).to_numpy().tobytes(), b"".join(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), *[pa.binary()] * 3))], names=["pack", "classes", "ns", "tokens"])

    return sets.mapInArrow(run, "pack long, classes binary, ns binary, tokens binary")


def rarest_first(packed: DataFrame, threshold: Threshold, buckets: int) -> DataFrame:
    """Of the packed sets those that may link: class, n, their shared tokens rarest first, how many are prefix, and group.

    A token's frequency is the number of sets that have it; a pack sends each of its tokens once, with the number of its sets that have it, so
    what arrives for the most frequent token grows with the packs, not the sets. Tokens of one set only are dropped: they count in n, but match nothing.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = np.sort(np.frombuffer(tokens, dtype=np.uint64))
                first, n = _runs(t)
                rows = [(b, pack, x.tobytes(), y.astype("<u4").tobytes()) for b, x, y in _postings(t[first], n, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "pack", "tokens", "counts"])

    def frequency(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
        t, n = np.concatenate(parts), _joined(table, "counts", np.dtype("<u4")).astype(np.int64)
        order = np.argsort(t)
        t, n = t[order], n[order]
        first, _ = _runs(t)
        t, total = t[first], np.add.reduceat(n, first)
        t, total = t[total > 1], np.minimum(total[total > 1], 0xFFFFFFFF).astype("<u4")
        rows = []
        for pack, own in zip(table.column("pack").to_pylist(), parts):
            i = np.searchsorted(t, own)
            i = i[(i < len(t)) & (t[np.minimum(i, len(t) - 1)] == own)] if len(t) else i[:0]
            rows.append((pack, t[i].tobytes(), total[i].tobytes()))
        release()
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("pack", "tokens", "counts"), zip(*rows), (pa.int64(), pa.binary(), pa.binary()))})

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for classes, ns, tokens, parts in zip(*[x.to_pylist() for x in batch.columns]):
                n, t = np.frombuffer(ns, dtype=np.int64), np.frombuffer(tokens, dtype=np.uint64)
                known, f = np.frombuffer(b"".join(p["tokens"] for p in parts), dtype=np.uint64), np.frombuffer(b"".join(p["counts"] for p in parts), dtype="<u4")
                by = np.argsort(known)
                known, f, owner = known[by], f[by], np.repeat(np.arange(len(n)), n)
                i = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
                shared = known[i] == t if len(known) else np.zeros(len(t), dtype=bool)
                t, i, owner = t[shared], i[shared], owner[shared]
                by = np.lexsort((t, f[i], owner))
                t, have = t[by], np.bincount(owner, minlength=len(n))
                need, ends = threshold.need(n), starts(have).tolist()
                prefix = np.maximum(0, n - need + 1 - (n - have))
                for k in np.flatnonzero(have >= need).tolist():
                    own = t[ends[k] : ends[k + 1]]
                    group = class_ids(own[: prefix[k]] ^ np.uint64(n[k]), np.array([0, prefix[k]]))[0]
                    rows.append((int(np.frombuffer(classes, dtype=np.int64)[k]), int(n[k]), own.tobytes(), int(prefix[k]), int(group)))
            release()
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))], names=["class", "n", "tokens", "prefix", "group"]
                )

    asked = packed.select("pack", "tokens").mapInArrow(send, "bucket int, pack long, tokens binary, counts binary")
    parts = by_number(asked, "bucket", buckets, frequency, "pack long, tokens binary, counts binary").groupBy("pack").agg(F.collect_list(F.struct("tokens", "counts")).alias("parts"))
    return packed.join(parts, "pack").select("classes", "ns", "tokens", "parts").mapInArrow(order, "class long, n long, tokens binary, prefix long, group long")


def _heads(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The prefix tokens of the rows (tokens, prefix, ...), one row after the other, and how many each has."""
    p = batch.column(1).to_numpy(zero_copy_only=False)
    return np.concatenate([np.frombuffer(x, dtype=np.uint64, count=int(k)) for x, k in zip(batch.column(0).to_pylist(), p)]), p


def group_edges(sets: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) that connect all groups which share a prefix token.

    A batch connects its groups of a token to the least of them, and only that one is sent for the token.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, p = _heads(batch)
            g = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), p)
            order = np.lexsort((g, t))
            t, g = t[order], g[order]
            first, n = _runs(t)
            least = np.repeat(g[first], n)
            near = np.unique(np.stack([g, least])[:, g != least], axis=1) if len(g) else np.zeros((2, 0), np.int64)
            rows = [(b, x.tobytes(), y.tobytes(), b"") for b, x, y in _postings(t[first], g[first], buckets)]
            rows.append((int(rows[0][0]) if rows else 0, b"", b"", near.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 3))], names=["bucket", "tokens", "groups", "edges"])

    def join(table: pa.Table) -> pa.Table:
        t, g = _joined(table, "tokens", np.uint64), _joined(table, "groups", np.int64)
        order = np.lexsort((g, t))
        t, g = t[order], g[order]
        first, n = _runs(t)
        parts = [np.stack([g, np.repeat(g[first], n)]), *[np.frombuffer(x, dtype=np.int64).reshape(2, -1) for x in table.column("edges").to_pylist()]]
        a, b = np.concatenate(parts, axis=1)
        a, b = np.unique(np.stack([a, b])[:, a != b], axis=1)
        release()
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    sent = sets.select("tokens", "prefix", "group").mapInArrow(send, "bucket int, tokens binary, groups binary, edges binary")
    return by_number(sent, "bucket", buckets, join, "a long, b long")


def _pairs(tokens: np.ndarray, member: np.ndarray, size: int) -> np.ndarray:
    """How many tokens each two of the members share, from (token, member): a size x size matrix."""
    out = np.zeros((size, size), dtype=np.int32)
    order = np.argsort(tokens, kind="stable")
    t, m = tokens[order], member[order]
    first, n = _runs(t)
    wide = n > max(24, size // 16)
    for chunk in np.array_split(np.flatnonzero(wide), max(1, int(wide.sum()) // 1024)):
        if len(chunk):
            dense = np.zeros((size, len(chunk)), dtype=np.float32)
            index = np.repeat(first[chunk] - starts(n[chunk])[:-1], n[chunk]) + np.arange(int(n[chunk].sum()))
            dense[m[index], np.repeat(np.arange(len(chunk)), n[chunk])] = 1
            out += (dense @ dense.T).astype(np.int32)
    for k in np.unique(n[~wide & (n > 1)]).tolist():
        lists = m[first[(n == k) & ~wide][:, None] + np.arange(k)]
        a, b = np.triu_indices(k, 1)
        step = max(1, 2_000_000 // len(a))
        for at in range(0, len(lists), step):
            x, y = lists[at : at + step][:, a].ravel(), lists[at : at + step][:, b].ravel()
            hits = np.bincount(x.astype(np.int64) * size + y, minlength=size * size).reshape(size, size)
            out += hits.astype(np.int32)
            out += hits.T.astype(np.int32)
    return out


def _compare(table: pa.Table, threshold: Threshold) -> pa.Table:
    """The links of a tile: pairs of groups that share a prefix token and are of about one size, and of those the members that link."""
    classes, n = table.column("class").to_numpy(), table.column("n").to_numpy()
    prefix, second = table.column("prefix").to_numpy(), table.column("second").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("tokens").to_pylist()]
    heads: dict[tuple[int, bytes], int] = {}
    group = np.fromiter((heads.setdefault((int(k), s[:p].tobytes()), len(heads)) for k, p, s in zip(n, prefix, sets)), dtype=np.int64, count=len(sets))
    sizes = np.array([k for k, _ in heads], dtype=np.int64)
    tokens = [np.frombuffer(t, dtype=np.uint64) for _, t in heads]
    near = _pairs(np.concatenate(tokens), np.repeat(np.arange(len(heads)), [len(x) for x in tokens]), len(heads)) > 0
    near &= threshold.need(np.maximum(sizes[:, None], sizes)) <= np.minimum(sizes[:, None], sizes)
    np.fill_diagonal(near, True)
    # expand the pairs of groups left, and count what each two of their members have in common
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    at = starts(np.array([len(x) for x in sets]))
    has = np.zeros(len(local) and int(local.max()) + 1, dtype=bool)
    crossing = table.column("tile")[0].as_py()["crossing"]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(near[group[i], group[i + 1 :]])
        if crossing:  # pairs within a block are another tile's
            others = others[second[others] != second[i]]
        if not len(others):
            continue
        has[local[at[i] : at[i + 1]]] = True
        size = at[others + 1] - at[others]
        ends = starts(size)
        both = np.add.reduceat(has[local[np.repeat(at[others] - ends[:-1], size) + np.arange(ends[-1])]].astype(np.int64), ends[:-1])
        has[local[at[i] : at[i + 1]]] = False
        ok = threshold.links(both, n[i], n[others])
        found.append((np.full(int(ok.sum()), classes[i]), classes[others[ok]], both[ok]))
    a, b, both = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((3, 0), np.int64)
    del sets, local, near, tokens
    release()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "both": pa.array(both, pa.int64())})


def class_links(sets: DataFrame, threshold: Threshold, folder: str, tokens: int) -> DataFrame:
    """All links (a, b, both) between sets (class, n, tokens rarest first, prefix, group)."""
    root = components(group_edges(sets, max(1, tokens // BUCKET_TOKENS)), f"{folder}/roots")
    members = sets.groupBy("group").agg(F.count("*").alias("members"))
    single = members.filter("members > 1").select(F.col("group").alias("node"), F.col("group").alias("root"))
    # a group alone in its component matters only if it has several members
    root = root.union(single.join(root, "node", "left_anti"))
    sized = root.join(members, root["node"] == members["group"]).groupBy("root").agg(F.sum("members").alias("size"))
    sized = materialize(root.join(sized, "root").select(F.col("node").alias("group"), "root", "size"), f"{folder}/components")
    small = max(1, (sized.filter(F.col("size") <= BLOCK // 2).agg(F.count("*")).first()[0]) * 2 // BLOCK)
    placed = sets.join(sized, "group")
    none = F.lit(0).cast("int")

    def tile(of, i, j):
        return F.struct(of.alias("of"), *[c.alias(f"{x}{k}") for x, p in (("i", i), ("j", j)) for k, c in enumerate(p)], (F.lit(False) if i is j else (i[0] != j[0]) | (i[1] != j[1])).alias("crossing"))

    keep = ["class", "n", "prefix", "tokens"]
    whole = placed.filter(F.col("size") <= BLOCK // 2).select(tile(F.pmod(F.xxhash64("root"), F.lit(small)), (none, none), (none, none)).alias("tile"), *keep, F.lit(False).alias("second"))
    # large components: blocks by band of sizes, as sets two bands apart can't link, and by hash within a band
    large = placed.filter(F.col("size") > BLOCK // 2).withColumn("band", F.floor(F.log(F.col("n")) / max(1e-6, math.log(100 / threshold.percent))).cast("int"))
    bands = large.groupBy("root", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    large = materialize(large.join(bands, ["root", "band"]).withColumn("salt", F.pmod(F.xxhash64("class"), "blocks").cast("int")), f"{folder}/large")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            t, p = _heads(batch)
            rest = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), p)) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), *rest], names=["token", "class", "band", "salt"])

    posts = large.select("tokens", "prefix", "class", "band", "salt").mapInArrow(explode, "token long, class long, band int, salt int")
    there = posts.select("token", F.col("band").alias("band2"), F.col("salt").alias("salt2")).distinct()
    mates = posts.join(there, "token").filter("abs(band - band2) <= 1").select("class", "band2", "salt2").distinct()
    own, other = (F.col("band"), F.col("salt")), (F.col("band2"), F.col("salt2"))
    first = (own[0] < other[0]) | (own[0] == other[0]) & (own[1] <= other[1])
    i, j = [tuple(F.when(first, x).otherwise(y) for x, y in zip(p, q)) for p, q in ((own, other), (other, own))]
    cut = large.join(mates, "class").select(tile(F.col("root"), i, j).alias("tile"), *keep, (~first).alias("second"))
    compare = lambda t: _compare(t, threshold)
    schema = "a long, b long, both long"
    return whole.groupBy("tile").applyInArrow(compare, schema).union(cut.groupBy("tile").applyInArrow(compare, schema))


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``df``: key, n_shingles, n_similar, component_id, class_id.

    Documents link by 100 * intersection >= percent * union of their shingle sets; a copy links with its copies. n_similar counts the
    other documents linked directly, component_id is the least key reached by links. A document without words, or null, links with nothing and
    is its own component. Keys are integers; rows with equal keys are documents of their own; a null key counts in n_similar
    and its component_id is the least non-null key of its component, or null. An empty table gives no rows.
    """
    spark, folder, threshold = df.sparkSession, shared_dir(df.sparkSession), Threshold(percent)
    source = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    buckets = max(1, text_bytes(source, "text") // BUCKET_BYTES)
    first = materialize(documents_and_shared(source, size, threshold, buckets), f"{folder}/first")
    docs = first.filter("n is not null").select("key", "n", "class")
    classes = first.groupBy("class").agg(F.min("key").alias("least"), F.max("n").alias("n"), F.count("n").alias("members"), F.sum("shared").alias("shared"))
    n = F.col("n")
    need = F.ceil(n * percent / 100)
    classes = materialize(classes, f"{folder}/classes")
    suspects = classes.filter((n > 0) & (F.col("shared") >= F.greatest(F.lit(1), F.ceil(need / 10))))
    wanted = Filter(suspects.select("class"), suspects.count())
    sets = whole_sets(source, size, wanted).join(suspects.select("class"), "class", "left_semi").dropDuplicates(["class"])
    packed = materialize(packs(sets), f"{folder}/packs")
    tokens = packed.agg(F.sum(F.length("tokens"))).first()[0] or 0
    ordered = materialize(rarest_first(packed, threshold, max(1, tokens // 8 // BUCKET_TOKENS)), f"{folder}/ordered")
    drop_dir(f"{folder}/packs")
    links = materialize(class_links(ordered, threshold, folder, tokens // 8), f"{folder}/links")
    both = links.select("a", "b").union(links.select("b", "a"))
    linked = both.join(classes.select(F.col("class").alias("b"), "members"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("members").alias("others"))
    root = components(links.select("a", "b"), f"{folder}/linked")
    lowest = root.join(classes, root["node"] == classes["class"]).groupBy("root").agg(F.min("least").alias("component"))
    named = root.join(lowest, "root").select(F.col("node").alias("class"), "component")
    per_class = (
        classes.select("class", "least", "members").join(linked, "class", "left").join(named, "class", "left")
        .select("class", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), F.coalesce("component", "least").alias("component_id"))
    )
    empty = F.col("n") == 0
    result = docs.join(per_class, "class", "left").select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(empty, F.lit(0)).otherwise(F.col("n_similar")).cast("long").alias("n_similar"),
        F.when(empty, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("class").alias("class_id"),
    )
    result = materialize(result, f"{folder}/result")
    for done in ("first", "classes", "ordered", "roots", "components", "large", "links", "linked"):
        drop_dir(f"{folder}/{done}")
    return result


def keep_documents(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Of rows that are linked, directly or over others, the one with the least key; of equal texts under one key one. Columns are unchanged.

    A null key counts as a large number made from the row. Different texts under one key are different documents, each with a number of its own:
    a 64-bit hash of both. So a group's least number names that group only; of those with its least key the one with the least number stays.
    Rows that a Bloom filter of the numbers in groups, of bounded size, doesn't know stay where they are; only the others are shuffled.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    marker = F.shiftrightunsigned(F.xxhash64(*[df[c] for c in df.columns]), 2) + F.lit(1 << 62)
    own = F.coalesce(df[key].cast("long"), marker)
    number = F.xxhash64(own, df[text])
    found = similar_documents(df.select(number.alias("key"), df[text].alias("text")), "key", "text", size, percent)
    times = found.groupBy("key").agg(F.min("component_id").alias("of"), F.count("*").alias("times"))
    members = times.join(df.select(number.alias("key"), own.alias("own")).distinct(), "key")
    groups = members.groupBy("of").agg(F.min(F.struct("own", "key")).alias("least"), F.sum("times").alias("rows")).filter("rows > 1")
    grouped = materialize(members.join(groups, "of").select("key", (F.col("key") == F.col("least.key")).alias("stays")), f"{folder}/grouped")
    known = Filter(grouped.select("key"), grouped.count(), each=24)
    mark = "number"
    while mark in df.columns:
        mark += "_"
    marked = df.select(number.alias(mark), *[df[c] for c in df.columns])

    def part(some: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array(known.has(batch.column(0).to_numpy(zero_copy_only=False)) == some))

        return marked.mapInArrow(run, marked.schema)

    judged = part(True).join(grouped.select(F.col("key").alias(mark), "stays"), mark, "left").filter("stays is null or stays").dropDuplicates([mark])
    return part(False).select(*df.columns).unionByName(judged.select(*df.columns))


def query(spark, sf_dir: str) -> DataFrame:
    found = similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "n_similar", "component_id")


ORACLE_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 80 * (p.n + q.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.n, 0)::BIGINT AS n_similar, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) l USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)
"""
