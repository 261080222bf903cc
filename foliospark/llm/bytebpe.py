"""Byte-level BPE: merges are replayed over all distinct words at once, in rank order, from an index of token pairs."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import array, flat, narrow, slices, starts

#: Words that a worker remembers; beyond that it forgets all and starts anew.
CACHE = 400_000
_NONE = 1 << 60


def gather(lengths: np.ndarray, flat_values: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``codes`` name, one after the other, and the length of each; a list's values are in ``flat_values``."""
    at = starts(lengths)
    n = lengths[codes]
    out_at = starts(n)
    index = np.repeat(at[codes] - out_at[:-1], n)
    index += np.arange(len(index), dtype=np.int64)
    return flat_values[index], n


def word_of(lengths: np.ndarray) -> np.ndarray:
    """The number of the word that each byte is in."""
    return np.repeat(np.arange(len(lengths)), lengths)


class ByteBpe:
    """A vocabulary of byte strings by rank, with the pattern that cuts a text into words."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ranks = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self._table(pairs)
        self.token_lengths = np.fromiter(map(len, self.tokens), dtype=np.int64, count=size)
        self.token_bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}

    def _table(self, pairs: dict[int, int]) -> None:
        """An open hash table of the pairs, 2^20 slots; -2 marks a free one."""
        if len(pairs) > 700_000:
            raise ValueError("the vocabulary has too many pairs for the table")
        self.slot_keys, self.slot_ranks = np.full(1 << 20, -2, dtype=np.int64), np.full(1 << 20, _NONE, dtype=np.int64)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        ranks = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            free = first[self.slot_keys[slot[first]] == -2]
            self.slot_keys[slot[free]], self.slot_ranks[slot[free]] = keys[free], ranks[free]
            rest = np.ones(len(keys), dtype=bool)
            rest[free] = False
            keys, ranks, slot = keys[rest], ranks[rest], (slot[rest] + 1) & 0xFFFFF

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has.

        All words lie in one chain of symbols. ``index`` maps a rank to the places where its pair begins. Ranks are
        taken in order, and all places of a rank are merged at once; a merge touches only the two neighbours of its
        place, whose new pairs are added to the index. Places that an earlier merge changed are skipped. A word's first place
        goes first and its others wait for another turn, after any lower rank that the merge may have made, so each word is merged
        lowest rank first, leftmost first.
        """
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        flat_symbols = self.byte_ranks[raw[np.repeat(whole < 0, lengths)]]
        lengths[whole >= 0] = 1
        filled = np.empty(int(lengths.sum()), dtype=np.int64)
        single = starts(lengths)[:-1][whole >= 0]
        several = np.ones(len(filled), dtype=bool)
        several[single] = False
        filled[single], filled[several] = whole[whole >= 0], flat_symbols
        begins = starts(lengths + 1)[:-1] + 1
        total = len(filled) + len(words) + 1
        word = np.repeat(np.arange(-1, len(words)), np.concatenate([[1], lengths + 1]))
        symbols = np.full(total, -1, dtype=np.int64)
        symbols[np.arange(len(filled)) + word_of(lengths) + 1] = filled
        right, left = np.arange(1, total + 1), np.arange(-1, total - 1)
        rank = np.full(total, _NONE, dtype=np.int64)
        rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            ends = [0, *cuts.tolist(), len(ranks)]
            for r, a, b in zip(ranks[ends[:-1]].tolist(), ends, ends[1:]):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        some = np.flatnonzero(rank != _NONE)
        if len(some):
            add(some, rank[some])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            p = p[rank[p] == r]
            if len(p) > 1:
                p.sort()
                w = word[p]
                again = np.flatnonzero(w[1:] == w[:-1]) + 1
                if len(again):
                    add(p[again], np.full(len(again), r))
                    p = np.delete(p, again)
            if not len(p):
                continue
            gone = right[p]
            after = right[gone]
            before = left[p]
            symbols[p] = r
            rank[gone] = _NONE
            right[p] = after
            left[after] = p
            m = len(p)
            places = np.concatenate([p, before])
            a = np.full(2 * m, r)
            b = a.copy()
            a[m:], b[:m] = symbols[before], symbols[after]
            new = self.rank_of(a, b)
            rank[places] = new
            some = np.flatnonzero(new != _NONE)
            if len(some):
                add(places[some], new[some])
        places = begins[lengths > 0]
        live = np.zeros(total, dtype=bool)
        while len(places):
            live[places] = True
            places = right[places]
            places = places[symbols[places] >= 0]
        return symbols[live], np.bincount(word[live], minlength=len(words))

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the pairs; negative symbols aren't part of any."""
        keys = a << 24 | b
        keys[(a < 0) | (b < 0)] = -1
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = np.full(len(keys), _NONE, dtype=np.int64)
        left = np.arange(len(keys))
        while len(left):
            there = self.slot_keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.slot_ranks[slot[hit]]
            on = ~hit & (there != -2)
            left, slot = left[on], (slot[on] + 1) & 0xFFFFF
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that aren't known yet."""
        known = self.known
        new = list({w for w in words if w not in known})
        ids, counts = self.replay([w.encode() for w in new])
        raw, ends = ids.astype("<u4").tobytes(), (4 * starts(counts)).tolist()
        known.update(zip(new, [raw[a:b] for a, b in zip(ends, ends[1:])]))

    def encode_whole(self, text: str) -> bytes:
        words = self.words.findall(text)
        self.learn(words)
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text; a null text has none.

        Texts are cut at single spaces into pieces; where each piece begins and ends with something other than white
        space the pattern can't match across the cuts, so that only distinct pieces need it. Other texts go
        through the pattern as a whole.
        """
        if len(self.known) > CACHE or len(self.pieces) > CACHE:
            self.known, self.pieces = {}, {}
        values, at = flat(pc.split_pattern(array(texts), " "))
        rows, counts = len(at) - 1, np.diff(at)
        if not len(values):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        coded = values.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        first = np.zeros(len(codes), dtype=bool)
        first[at[:-1][counts > 0]] = True
        leads = np.unique(codes[first])
        units = [" " + p for p in distinct]
        units.extend(distinct[k] for k in leads.tolist())
        pieces, find = self.pieces, self.words.findall
        new = [u for u in units if u not in pieces]
        cut = [None if u in ("", " ") or u[-1].isspace() or (u[1:2] if u[0] == " " else u[0]).isspace() else find(u) for u in new]
        self.learn(w for c in cut if c is not None for w in c)
        known = self.known
        for u, c in zip(new, cut):
            pieces[u] = None if c is None else known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c])
        ids = [pieces[u] for u in units]
        bad = np.fromiter((x is None for x in ids), dtype=bool, count=len(ids))
        lengths = np.fromiter((0 if x is None else len(x) >> 2 for x in ids), dtype=np.int64, count=len(ids))
        values_ = np.frombuffer(b"".join([x for x in ids if x is not None]), dtype="<u4")
        codes[first] = len(distinct) + np.searchsorted(leads, codes[first])
        n = np.zeros(rows, dtype=np.int64)
        broken = np.zeros(rows, dtype=bool)
        doc = np.repeat(np.arange(rows), counts)
        broken[doc[bad[codes]]] = True
        if not broken.any():
            got, each = gather(lengths, values_, codes)
            return got, np.bincount(doc, weights=each, minlength=rows).astype(np.int64)
        keep = ~broken[doc]
        got, each = gather(lengths, values_, codes[keep])
        n += np.bincount(doc[keep], weights=each, minlength=rows).astype(np.int64)
        parts, ends = [], np.cumsum(n)
        begin = 0
        for d in np.flatnonzero(broken):
            parts.append(got[begin : ends[d]])
            begin = ends[d]
            whole = np.frombuffer(self.encode_whole(texts[int(d)].as_py()), dtype="<u4")
            parts.append(whole)
            n[d] = len(whole)
        parts.append(got[begin:])
        return np.concatenate(parts), n

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the number of bytes of each."""
        return gather(self.token_lengths, self.token_bytes, ids.astype(np.int64))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """One vocabulary per worker and file."""
    return ByteBpe(path, pattern)


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every row and ``ids``, its text's token ids. A null or empty text has none; repeated rows give equal rows."""
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in slices(batches):
            ids, n = bpe.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(starts(n).astype(np.int32)), pa.array(ids.astype(np.int32)))], names=schema.names
            )

    return source.mapInArrow(run, schema)


def decode_documents(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The key of every row and ``decoded``, the bytes of its ids; null ids give no bytes."""
    source = narrow(df, key=key, ids=ids)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        for batch in slices(batches):
            values, at = flat(batch.column(1))
            raw, n = bpe.decode(values.to_numpy(zero_copy_only=False))
            ends = starts(n)[at]
            raw = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def digests(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text encoded and decoded again: the key and the columns of DIGEST. No shuffle."""
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *DIGEST.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches):
            ids, n = bpe.encode(batch.column(1))
            raw, lengths = bpe.decode(ids)
            at = starts(n)
            cut = starts(lengths)[at]
            ids, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(raw.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n),
                    pa.array([sha(ids[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())], pa.string()),
                    pa.array([sha(raw[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.string()),
                ],
                names=schema.names,
            )

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
