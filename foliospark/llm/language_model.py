"""An n-gram language model of the whole corpus in Elias-Fano tries that are memory-mapped for scoring.

The vocabulary, every distinct token and its count, and the tries are files of the shared folder. A trie file holds the n-grams of all orders that
begin with a range of words; a word with very many tokens has files of its own, its successors split over them. Every level
of a trie has, as an Elias-Fano sequence, monotone pointers from each context, which is an entry of the level above, to its successors; the
successors in order in as many bits as a word needs; and for each a smoothed log probability in 16 bits. A lookup takes the two pointers of
the context and searches for the word among that context's successors only. A batch of texts is looked up in all files at once, as the arrays of mapped files
are read as one: what a batch costs doesn't follow from how many files there are.

Smoothing interpolates absolute discounting, with three discounts for each order that come from the counts of counts of the whole corpus, with the add-one
unigram model. So probabilities of all words and an unknown one sum to one before rounding, and rounding only lowers them. How the
files are cut changes no probability.
"""

from __future__ import annotations

import ctypes
import mmap
import sys
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, by_number, drop_dir, file_system, materialize, narrow, release, shared_dir, slices, starts, sums, text_bytes, word_hashes

#: Stand-ins for hashes of words: the context of a text's first word, and the token after its last.
BEGIN, END = np.uint64(1), np.uint64(2)
#: Words of the longest n-gram that the query counts.
ORDER = 3
#: Log probabilities are kept as multiples of this, rounded down.
STEP = 1 / 4096
#: Tokens whose n-grams one file is about for; a word with more is split. Bytes of tries that a worker keeps where it can't map files.
FILE_TOKENS, KEPT_BYTES = 2_500_000, 256 << 20
#: Mapped files that are looked up together, and that a worker keeps mapped: about half of what Linux lets a process map.
JOINED, KEPT_FILES = 8192, 32768
#: Places that are looked up at once: arrays over them stay in a core's cache.
AT_ONCE = 1 << 15


def joined(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One array from the first address to the last, and where in it each of the arrays begins. What lies between them must not be read; the caller
    keeps the arrays."""
    if len(arrays) == 1:
        return arrays[0], np.zeros(1, dtype=np.int64)
    begin, size, kind = np.array([a.ctypes.data for a in arrays], dtype=np.int64), np.array([a.nbytes for a in arrays]), arrays[0].dtype
    some = np.flatnonzero(size)
    if not len(some):
        return arrays[0], np.zeros(len(arrays), dtype=np.int64)
    low, high = int(begin[some].min()), int((begin + size)[some].max())
    return np.frombuffer((ctypes.c_char * (high - low)).from_address(low), dtype=kind), np.where(size > 0, begin - low, 0) // kind.itemsize


def below(values: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The last place from ``low`` on whose value is ``want`` at most, for each; values rise, the one at ``low`` is ``want`` at most, and ``high`` is past it."""
    for _ in range(int((high - low).max(initial=1) - 1).bit_length()):
        middle = (low + high) >> 1
        less = values[middle] <= want
        low, high = np.where(less, middle, low), np.where(less, high, middle)  # where one place is left, nothing moves
    return low


def bits_of(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, packed into 64-bit words, with a word to spare."""
    words = np.zeros(len(values) * width // 64 + 2, dtype=np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        low = values.astype(np.uint64) & np.uint64((1 << width) - 1)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, low << shift)
        over = shift + np.uint64(width) > 64
        np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    return words


def bits_at(packed: np.ndarray, width: int | np.ndarray, i: np.ndarray, start: int | np.ndarray = 0) -> np.ndarray:
    """The packed numbers at the places ``i`` from the word ``start`` on."""
    width = np.asarray(width).astype(np.uint64)
    at = i.astype(np.uint64) * width
    word, shift = (at >> np.uint64(6)).astype(np.int64) + start, at & np.uint64(63)
    both = packed[word] >> shift
    # two shifts, as one by 64 bits gives nothing defined
    both |= (packed[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
    return both & ((np.uint64(1) << width) - np.uint64(1))


class EliasFano:
    """Non-decreasing sequences of n numbers below a limit in about 2 + log2(limit / n) bits each; those of several files have a part each."""

    BLOCK = 8  # words of high bits between two entries of the directory

    def __init__(self, *files: list[np.ndarray]):
        heads, *arrays = zip(*files)
        self.files, self.width = files, np.array([w for _, w in heads], dtype=np.int64)
        (self.low, self.low_at), (self.high, self.high_at), (self.ones, self.ones_at) = (joined(a) for a in arrays)
        self.blocks = np.array([len(a) - 1 for a in arrays[2]])

    @classmethod
    def build(cls, values: np.ndarray, limit: int) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, (limit // max(1, n)).bit_length() - 1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        length = n + (limit >> width) + 2
        flags = np.zeros(-(-length // (64 * cls.BLOCK)) * 64 * cls.BLOCK, dtype=np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        directory = starts(np.bitwise_count(high).reshape(-1, cls.BLOCK).sum(axis=1).astype(np.int64))
        return cls([np.array([n, width], dtype=np.int64), bits_of(values, width), high, directory])

    def parts(self) -> list[np.ndarray]:
        return list(self.files[0])

    def select(self, k: np.ndarray, part: int | np.ndarray = 0) -> np.ndarray:
        """The position of the k-th one among the high bits, from 0."""
        at = self.ones_at[part]
        block = below(self.ones, np.zeros_like(k) + at, at + self.blocks[part], k)
        left, start = k - self.ones[block], self.high_at[part]
        word = (block - at) * self.BLOCK
        for _ in range(self.BLOCK - 1):
            here = np.bitwise_count(self.high[start + word]).astype(np.int64)
            on = left >= here
            left, word = left - here * on, word + on
        bits, at = self.high[start + word], np.zeros(len(k), dtype=np.uint64)
        for half in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count((bits >> at) & np.uint64((1 << half) - 1)).astype(np.int64)
            on = left >= here
            left, at = left - here * on, at + np.uint64(half) * on.astype(np.uint64)
        return word * 64 + at.astype(np.int64)

    def _number(self, position: np.ndarray, i: np.ndarray, part: int | np.ndarray) -> np.ndarray:
        return ((position - i) << self.width[part]) | bits_at(self.low, self.width[part], i, self.low_at[part]).astype(np.int64)

    def get(self, i: np.ndarray, part: int | np.ndarray = 0) -> np.ndarray:
        """The i-th number, for each i; part: of which sequence."""
        return self._number(self.select(i, part), i, part)

    def between(self, i: np.ndarray, part: int | np.ndarray = 0) -> tuple[np.ndarray, np.ndarray]:
        """The i-th number and the one after it: its one is mostly in the same word of the high bits or in the next."""
        position, part = self.select(i, part), np.broadcast_to(part, i.shape)
        word, bit = position >> 6, (position & 63).astype(np.uint64)
        start = self.high_at[part] + word
        here, there = self.high[start] >> bit >> np.uint64(1), np.full(len(i), -1, dtype=np.int64)
        near = here != 0
        # the ones below the lowest one of a word are as many as the zeros before it
        there[near] = position[near] + 1 + np.bitwise_count(~here[near] & (here[near] - np.uint64(1)))
        far = np.flatnonzero(~near)
        following = (word[far] + 1) // self.BLOCK < self.blocks[part[far]]
        far, bits = far[following], self.high[start[far[following]] + 1]
        far, bits = far[bits != 0], bits[bits != 0]
        there[far] = (word[far] + 1) * 64 + np.bitwise_count(~bits & (bits - np.uint64(1)))
        rest = np.flatnonzero(there < 0)
        there[rest] = self.select(i[rest] + 1, part[rest])
        return self._number(position, i, part), self._number(there, i + 1, part)


def save(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, each aligned to eight bytes, after a table of types and lengths."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        table = np.array([[ord(a.dtype.kind), a.dtype.itemsize, len(a)] for a in arrays], dtype="<i8")
        out.write(np.array([len(arrays)], dtype="<i8").tobytes() + table.tobytes())
        for a in arrays:
            out.write(a.tobytes() + bytes(-a.nbytes % 8))


def mapped(uri: str) -> tuple[list[np.ndarray], int]:
    """The arrays of a file, and how many bytes of memory they take: none if mapped, all where the file system can't map."""
    system, path = file_system(uri)
    local = system.type_name == "local"
    if local:
        with open(path, "rb") as f:  # mapped files aren't kept open where that can be said
            raw = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {})), dtype=np.uint8)
    else:
        raw = np.frombuffer(system.open_input_file(path).read(), dtype=np.uint8)
    count = int(raw[:8].view("<i8")[0])
    table, at, out = raw[8 : 8 + 24 * count].view("<i8").reshape(count, 3), 8 + 24 * count, []
    for kind, size, n in table.tolist():
        out.append(raw[at : at + n * size].view(np.dtype(f"<{chr(kind)}{size}")))
        at += -(-n * size // 8) * 8
    return out, 0 if local else len(raw)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash: equal shares of all 64-bit numbers, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Ranges:
    """Hashes and counts of some ranges' files."""

    def __init__(self, *files: list[np.ndarray]):
        self.files, self.n = files, np.array([len(known) for known, _ in files])
        (self.known, self.known_at), (self.counts, self.counts_at) = joined([f[0] for f in files]), joined([f[1] for f in files])

    def find(self, hashes: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The place of each hash in its part, -1 for unknown ones."""
        out, some = np.full(len(hashes), -1, dtype=np.int64), np.flatnonzero(self.n[part])
        hashes, part = hashes[some], part[some]
        start = self.known_at[part]
        i = below(self.known, start, start + self.n[part], hashes)
        out[some] = np.where(self.known[i] == hashes, i - start, -1)
        return out


class Vocabulary:
    """Word hashes in order, over all ranges, and their counts. A word's id is its place."""

    def __init__(self, paths: tuple[str, ...], at: np.ndarray):
        self.paths, self.at = paths, at

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of hashes, -1 for unknown ones."""
        order = np.argsort(hashes)
        sorted_, found = hashes[order], np.full(len(hashes), -1, dtype=np.int64)
        file = range_of(sorted_, len(self.paths))
        for ranges, own, part in looked_up(self.paths, file, Ranges):
            i = ranges.find(sorted_[own], part)
            found[own] = np.where(i >= 0, i + self.at[file[own]], -1)
        out = np.empty_like(found)
        out[order] = found
        return out

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """How often each word is in the training texts; 0 for unknown ones."""
        out, file = np.zeros(len(ids), dtype=np.int64), np.searchsorted(self.at, ids, side="right") - 1
        for ranges, own, part in looked_up(self.paths, file, Ranges):
            out[own] = ranges.counts[ranges.counts_at[part] + ids[own] - self.at[file[own]]]
        return out


_OPENED: OrderedDict[str, tuple[object, int, int]] = OrderedDict()


def opened(path: str, make=list, more: tuple[str, ...] = ()):
    """What ``make`` gives for a file's arrays, or for those of several, kept in the worker under the first's name: of mapped files the last used
    KEPT_FILES, of others up to KEPT_BYTES."""
    if path not in _OPENED:
        found = [mapped(p) for p in (path, *more)]
        size = sum(n for _, n in found)
        while _OPENED and (sum(n for _, n, _ in _OPENED.values()) + size > KEPT_BYTES or sum(n for _, _, n in _OPENED.values()) + len(found) > KEPT_FILES):
            _OPENED.popitem(last=False)
        _OPENED[path] = (make(*[arrays for arrays, _ in found]), size, len(found))
    _OPENED.move_to_end(path)
    return _OPENED[path][0]


def looked_up(paths: tuple[str, ...] | list[str], file: np.ndarray, make) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """For places that ask for files by number, or with a negative one for none: what ``make`` gives for files, at most AT_ONCE places that ask for these, in
    order, and for the how manieth of them. Mapped files are taken JOINED at a time, others alone."""
    each = JOINED if file_system(paths[0])[0].type_name == "local" else 1
    group = file // each
    asking = np.flatnonzero(file >= 0)
    if len(paths) > each:
        asking = asking[np.argsort(group[asking], kind="stable")]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[asking]) != 0, [True]])) if len(asking) else np.zeros(1, np.int64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        first = int(group[asking[a]]) * each
        made = opened(paths[first], make, tuple(paths[first + 1 : first + each]))
        for at in range(a, b, AT_ONCE):
            own = asking[at : min(b, at + AT_ONCE)]
            yield made, own, file[own] - first


class Level:
    """The n-grams of one order in a trie file: pointers of the contexts, their successors, codes, and what each context leaves to the order below. Or those in
    several files, which are the parts."""

    def __init__(self, *files: list[np.ndarray]):
        self.files, self.pointers, self.width = files, EliasFano(*[f[:4] for f in files]), int(files[0][5][0])
        (self.words, self.words_at), (self.codes, self.codes_at), (self.rest, self.rest_at) = (joined([f[i] for f in files]) for i in (4, 6, 7))

    @staticmethod
    def build(contexts: np.ndarray, words: np.ndarray, size: int, width: int, p: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
        """From distinct (context, word) in order, their probabilities and each context's rest."""
        pointers = EliasFano.build(starts(np.bincount(contexts, minlength=size)), len(words) + 1)
        return [*pointers.parts(), bits_of(words, width), np.array([width], dtype=np.int64), quantised(p), quantised(rest)]

    def find(self, contexts: np.ndarray, words: np.ndarray, part: int | np.ndarray = 0) -> np.ndarray:
        """The entry of each word among the successors of its context, -1 if there is none; equal contexts stand together, unknown words are -1."""
        if not len(contexts):
            return np.zeros(0, dtype=np.int64)
        part = np.broadcast_to(part, contexts.shape)
        first = np.flatnonzero(np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (part[1:] != part[:-1])]))
        times = np.diff(np.append(first, len(contexts)))
        begin, end = (np.repeat(x, times) for x in self.pointers.between(contexts[first], part[first]))
        out, going = np.full(len(words), -1, dtype=np.int64), np.flatnonzero((begin < end) & (words >= 0))
        low, high, want, start = begin[going], end[going] - 1, words[going].astype(np.uint64), self.words_at[part[going]]
        while len(going):
            middle = (low + high) >> 1
            here = bits_at(self.words, self.width, middle, start)
            hit, less = here == want, here < want
            out[going[hit]] = middle[hit]
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle - 1)
            on = np.flatnonzero(~hit & (low <= high))
            going, low, high, want, start = going[on], low[on], high[on], want[on], start[on]
        return out

    def scores(self, entries: np.ndarray, contexts: np.ndarray, lower: np.ndarray, partial: bool, part: int | np.ndarray = 0) -> np.ndarray:
        """Log probabilities from found entries and those of the order below; partial: entries don't include these."""
        part = np.broadcast_to(part, contexts.shape)
        out = -STEP * self.rest[self.rest_at[part] + contexts].astype(np.float64) + lower
        hit = np.flatnonzero(entries >= 0)
        own = -STEP * self.codes[self.codes_at[part[hit]] + entries[hit]].astype(np.float64)
        out[hit] = np.log10(10**own + 10 ** out[hit]) if partial else own
        return out


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.minimum(65535, np.ceil(-np.log10(p) / STEP)).astype(np.uint16)


class Trie(list):
    """The levels of a file, or of several, from order 2 on."""

    def __init__(self, *files: list[np.ndarray]):
        super().__init__(Level(*[f[i : i + 8] for f in files]) for i in range(0, len(files[0]), 8))


class Layout:
    """Which file has which n-grams: by the range of the first word, and for hot first words by the second one too.

    at: where each range's word ids start, and the end; hot: hot ids in order; parts: how many files each has.
    """

    def __init__(self, at: np.ndarray, hot: np.ndarray, parts: np.ndarray):
        self.at, self.hot, self.parts = at, hot, parts
        self.first = len(at) - 1 + starts(parts)
        self.base = np.concatenate([at[:-1], np.repeat(hot, parts)])  # the first context of each file
        self.width = max(1, int(at[-1]).bit_length())

    @property
    def files(self) -> int:
        return int(self.first[-1])

    def size(self, file: int) -> int:
        """How many first words a file is about."""
        return int(self.at[file + 1] - self.at[file]) if file < len(self.at) - 1 else 1

    def file_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The file of each pair; pairs of unknown contexts (-1) are in none (-1)."""
        file = np.searchsorted(self.at, contexts, side="right") - 1
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)
            own = self.hot[i] == contexts
            file[own] = self.first[i[own]] + np.maximum(words[own], 0) * self.parts[i[own]] // max(1, int(self.at[-1]))
        return file

    def runs(self, contexts: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(file, from, to) of pairs in order; pairs of unknown contexts are in none."""
        file = self.file_of(contexts, words)
        cuts = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1], [True]])) if len(file) else np.zeros(1, np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            if file[a] >= 0:
                yield int(file[a]), a, b


def distinct(key: np.ndarray, inverse: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Distinct values in order, how often each occurs, a place of each, and the number of the value at each place."""
    if not inverse:
        key, order = np.sort(key), None
    else:
        order = np.argsort(key)
        key = key[order]
    new = np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(key)))
    if order is None:
        return key[first], counts, None, None
    number = np.empty(len(key), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return key[first], counts, order[first], number


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Grams:
    """The n-grams of a batch of texts, order by order: distinct pairs of a context and a word, in order.

    word: each token's id, -1 for unknown ones; at: where each text's tokens start, and the end. last: no longer n-grams will be asked for, and
    no token's pair.
    """

    def __init__(self, word: np.ndarray, at: np.ndarray, begin: int, last: bool = False):
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[at[:-1]] = begin
        self.word, self.inner = word, np.ones(len(word), dtype=bool)
        self.inner[at[:-1]] = False
        self._take(np.arange(len(word)), context + 1, last)
        self.contexts -= 1

    def _take(self, where: np.ndarray, context: np.ndarray, last: bool) -> None:
        pairs, self.counts, one, self.number = distinct(context.astype(np.uint64) << np.uint64(32) | (self.word[where] + 1).astype(np.uint64), not last)
        self.where, self.one = where, None if one is None else where[one]
        self.contexts, self.words = _split(pairs)
        self.words -= 1

    def longer(self, known: np.ndarray | None = None, last: bool = False) -> None:
        """Go on to the next order, whose contexts are the numbers of this one's pairs; known: only of these pairs. A text's first token has no
        longer context than its begin."""
        number = np.full(len(self.word) + 1, -1, dtype=np.int64)
        number[self.where + 1] = self.number if known is None else np.where(known[self.number], self.number, -1)
        where = np.flatnonzero((number[:-1] >= 0) & self.inner)
        self._take(where, number[where], last)


def _tokens(words: Words, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words, with the end after each text's; where each text's tokens start, and the end."""
    at = words.at + np.arange(len(words.at))
    token = np.full(int(at[-1]), end)
    inside = np.ones(len(token), dtype=bool)
    inside[at[1:] - 1] = False
    token[inside] = codes
    return token, at


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned numbers as planes of bytes, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], dtype="<i8").tobytes()
    planes = (np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(raw: bytes) -> list[np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    count = int(data[:8].view("<i8")[0])
    at, out = 8 + 16 * count, []
    for size, n in data[8:at].view("<i8").reshape(-1, 2).tolist():
        out.append(np.ascontiguousarray(data[at : at + size * n].reshape(size, n).T).view(f"<u{size}").ravel())
        at += size * n
    return out


def _vocabulary_files(train: DataFrame, ranges: int, hot: int, folder: str) -> DataFrame:
    """Write each range's hashes and counts; rows (range, path, n_known, n_words, n_tokens, places and counts of hot words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(0), lower=True)
            h = np.concatenate([word_hashes(words.vocab), [END]])
            n = np.concatenate([np.bincount(words.codes, minlength=len(words.vocab)), [batch.num_rows]])
            order = np.argsort(h)
            h, n = h[order], n[order]
            cuts = np.searchsorted(range_of(h, ranges), np.arange(ranges + 1)).tolist()
            rows = [(r, h[a:b].tobytes(), n[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["range", "hashes", "counts"])

    def merge(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        h = np.frombuffer(b"".join(table.column("hashes").to_pylist()), dtype=np.uint64)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
        if r == 0:
            h, n = np.append(h, BEGIN), np.append(n, 0)
        known, _, _, number = distinct(h)
        total = np.bincount(number, weights=n, minlength=len(known)).astype(np.int64)
        path = f"{folder}/vocabulary-{r:06d}-{uuid.uuid4().hex}.bin"
        save(path, [known, total])
        many = np.flatnonzero(total > hot)
        longs = lambda x: pa.array(x, pa.int64())
        return pa.table(
            {
                "range": pa.array([r], pa.int32()), "path": [path], "n_known": longs([len(known)]), "n_words": longs([int((total > 0).sum())]),
                "n_tokens": longs([int(total.sum())]), "hot": pa.array([many.tolist()], pa.list_(pa.int64())), "hot_counts": pa.array([total[many].tolist()], pa.list_(pa.int64())),
            }
        )

    none = train.sparkSession.createDataFrame([(r, b"", b"") for r in range(ranges)], "range int, hashes binary, counts binary")
    rows = train.mapInArrow(count, "range int, hashes binary, counts binary").unionByName(none)
    schema = "range int, path string, n_known long, n_words long, n_tokens long, hot array<long>, hot_counts array<long>"
    return materialize(by_number(rows, "range", ranges, merge, schema), f"{folder}/vocabulary")


def _counted(train: DataFrame, known: Vocabulary, layout: Layout, order: int, folder: str) -> DataFrame:
    """Rows (file, data, stats): each file's distinct n-grams of all orders from two on with their counts, level by level.

    A task sends each distinct n-gram of a batch once, as a trie: every n-gram with the number of its successors, then those. stats: of each order
    how many n-grams occur once, twice, three and four times; then, of the file's first word, its followers: all, and kinds seen once, twice, more often.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = int(known.ids(np.array([BEGIN]))[0])
        for batch in slices(batches):
            words = Words(batch.column(0), lower=True)
            ids = known.ids(np.concatenate([word_hashes(words.vocab), [END]]))
            grams = Grams(*_tokens(words, ids[words.codes], ids[-1]), begin, last=order == 2)
            contexts, levels = grams.contexts, [(grams.words, grams.counts)]
            runs, offspring = list(layout.runs(contexts, grams.words)), []
            for k in range(3, order + 1):
                grams.longer(last=k == order)
                offspring.append(np.bincount(grams.contexts, minlength=len(levels[-1][0])))
                levels.append((grams.words, grams.counts))
            below = [starts(x) for x in offspring]
            rows = []
            for file, a, b in runs:
                packed = [np.diff(contexts[a:b] - layout.base[file], prepend=0).astype("<u4")]
                for k, (w, n) in enumerate(levels):
                    packed += [w[a:b].astype("<u4"), n[a:b].astype("<u4")]
                    if k < len(offspring):
                        packed.append(offspring[k][a:b].astype("<u4"))
                        a, b = int(below[k][a]), int(below[k][b])
                rows.append((file, _pack(packed)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["file", "data"])

    def merge(table: pa.Table) -> pa.Table:
        file = table.column("file")[0].as_py()
        parts = [_unpack(x.as_py()) for x in table.column("data") if len(x.as_py())]

        def column(i: int) -> np.ndarray:
            """A column of all parts, which let go of theirs."""
            out = np.concatenate([*(p[i] for p in parts), np.zeros(0, "<u4")])
            for p in parts:
                p[i] = None
            return out

        context = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]) if parts else np.zeros(0, np.uint64)
        packed, stats = [], []
        for k in range(order - 1):
            at = 1 + 3 * k
            pairs, _, _, number = distinct(context << np.uint64(32) | column(at))
            n = np.bincount(number, weights=column(at + 1), minlength=len(pairs)).astype("<u8")
            contexts, words = _split(pairs)
            packed += [np.diff(contexts, prepend=0).astype("<u4"), words.astype("<u4"), n]
            stats += [int((n == c).sum()) for c in (1, 2, 3, 4)]
            if k == 0:
                followers = [int(n.sum()), int((n == 1).sum()), int((n == 2).sum()), int((n > 2).sum())]
            if k < order - 2:
                context = np.repeat(number, column(at + 2)).astype(np.uint64)
        del parts, context, number
        release()
        return pa.table({"file": pa.array([file], pa.int32()), "data": pa.array([_pack(packed)], pa.binary()), "stats": pa.array([stats + followers], pa.list_(pa.int64()))})

    none = train.sparkSession.createDataFrame([(r, b"") for r in range(layout.files)], "file int, data binary")
    rows = train.mapInArrow(count, "file int, data binary").unionByName(none)
    return materialize(by_number(rows, "file", layout.files, merge, "file int, data binary, stats array<long>"), f"{folder}/counts")


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What is taken off counts of one, two, and three or more, from how many n-grams occur once to four times (Chen and Goodman's estimate).

    Each is a tenth at least and leaves a twentieth; half where such counts are missing.
    """
    y = ones / (ones + 2 * twos) if ones else 0.0
    ratios = ((1, twos, ones), (2, threes, twos), (3, fours, threes))
    return np.array([min(max(0.1, i - (i + 1) * y * more / fewer), i - 0.05) if fewer and y else 0.5 for i, more, fewer in ratios])


def _tries(counted: DataFrame, known: Vocabulary, layout: Layout, taken: list[np.ndarray], hot: dict[int, list[int]], total: int, kinds: int, folder: str) -> list[str]:
    """Write each file's trie; their paths. hot: of each file about one hot word, what follows that word in all its files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns, size, arrays = _unpack(data), layout.size(file), []
                for k, off in enumerate(taken):
                    contexts, words, n = np.cumsum(columns[3 * k], dtype=np.int64), columns[3 * k + 1].astype(np.int64), columns[3 * k + 2].astype(np.float64)
                    own = off[np.minimum(n, 3).astype(np.int64) - 1]
                    all_, left = np.bincount(contexts, weights=n, minlength=size), np.bincount(contexts, weights=own, minlength=size)
                    if k == 0 and file in hot:
                        all_[:], left[:] = hot[file][0], np.dot(hot[file][1:], off)
                    rest = np.where(all_ > 0, left / np.maximum(all_, 1), 1.0)
                    p = (n - own) / all_[contexts]
                    if k == 0:  # of orders over two only the discounted part is kept: the order below may be in any file, and is added when scoring
                        p += rest[contexts] * (known.counts_of(words) + 1) / (total + kinds + 1)
                    arrays += Level.build(contexts, words, size, layout.width, p, rest)
                    size = len(words)
                path = f"{folder}/trie-{file:06d}-{uuid.uuid4().hex}.bin"
                save(path, arrays)
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([path])], names=["file", "path"])

    written = materialize(counted.select("file", "data").mapInArrow(write, "file int, path string"), f"{folder}/tries")
    return [r["path"] for r in written.orderBy("file").collect()]


class Model:
    """Where the files of a trained model are, and its totals. Small: a path for each file."""

    def __init__(self, known: Vocabulary, layout: Layout, paths: list[str], order: int, total: int, distinct: int):
        self.known, self.layout, self.paths, self.order, self.total, self.distinct = known, layout, paths, order, total, distinct

    def measure(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        words = Words(texts, lower=True)
        ids = self.known.ids(np.concatenate([word_hashes(words.vocab), [END, BEGIN]]))
        counts = self.known.counts_of(ids)
        unigram = np.log10((counts + 1) / (self.total + 1 * (self.distinct + 1)))
        token, at = _tokens(words, words.codes, len(ids) - 2)
        grams, score = Grams(ids[token], at, int(ids[-1])), unigram[token]
        file = self.layout.file_of(grams.contexts, grams.words)
        local = grams.contexts - self.layout.base[file]
        for k in range(self.order - 1):
            entries, value = np.full(len(grams.words), -1, dtype=np.int64), score[grams.one]
            for trie, own, part in looked_up(self.paths, file, Trie):
                entries[own] = trie[k].find(local[own], grams.words[own], part)
                value[own] = trie[k].scores(entries[own], local[own], value[own], k > 0, part)
            score[grams.where] = value[grams.number]
            if k + 2 < self.order:
                grams.longer(entries >= 0)
                local, file = entries[grams.contexts], file[grams.contexts]
        return {
            "n_tokens": np.diff(at),
            "n_known": sums((counts > 0).astype(np.int64)[token], at),
            # text by text, as a running sum over a batch would lose digits; every text has a token
            "base_score": np.add.reduceat(unigram[token], at[:-1]) if len(at) > 1 else np.zeros(0),
            "score": np.add.reduceat(score, at[:-1]) if len(at) > 1 else np.zeros(0),
        }


def train(df: DataFrame, text: str = "text", order: int = ORDER, file_tokens: int = FILE_TOKENS) -> Model:
    """Learn n-grams of up to ``order`` words, two at least, from every row's text; a null one counts as empty. Two passes over the texts.

    Counts are merged per batch before the shuffles. How many files there are follows from the bytes of the texts, and a word that begins over ``file_tokens``
    n-grams has several, so none grows with the corpus. Files have new names in each attempt, and count only by the written tables that
    list them. More than 2^32 - 2 distinct words raise an error.
    """
    spark, order = df.sparkSession, max(2, order)
    folder, source = shared_dir(spark), narrow(df, text=text)
    ranges = max(1, -(-text_bytes(source, "text") // (6 * file_tokens)))
    words = _vocabulary_files(source, ranges, file_tokens, folder).orderBy("range").collect()
    total, kinds = sum(r["n_tokens"] for r in words), sum(r["n_words"] for r in words)
    at = starts(np.array([r["n_known"] for r in words], dtype=np.int64))
    if at[-1] > (1 << 32) - 2:
        raise ValueError(f"{at[-1]} distinct words are more than 32-bit ids can tell apart")
    hot = [(int(at[r["range"]]) + i, n) for r in words for i, n in zip(r["hot"], r["hot_counts"])]
    layout = Layout(at, np.array([i for i, _ in hot], dtype=np.int64), np.array([-(-n // file_tokens) for _, n in hot], dtype=np.int64))
    known = Vocabulary(tuple(r["path"] for r in words), at)
    counted = _counted(source, known, layout, order, folder)
    stats = counted.select("file", "stats").collect()
    taken = [discounts(*(sum(r["stats"][4 * k + i] for r in stats) for i in range(4))) for k in range(order - 1)]
    follow: dict[int, np.ndarray] = {}
    for r in stats:
        if r["file"] >= len(at) - 1:
            follow[int(layout.base[r["file"]])] = follow.get(int(layout.base[r["file"]]), 0) + np.array(r["stats"][-4:])
    shared = {r["file"]: follow[int(layout.base[r["file"]])].tolist() for r in stats if r["file"] >= len(at) - 1}
    paths = _tries(counted, known, layout, taken, shared, total, kinds, folder)
    for done in ("vocabulary", "counts", "tries"):
        drop_dir(f"{folder}/{done}")
    return Model(known, layout, paths, order, total, kinds)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``df``: key, n_tokens, n_known, base_score, score, all logs to base 10. No shuffle.

    A null or empty text has one token, the end. Repeated rows get equal scores.
    """
    source = narrow(df, key=key, text=text)
    fields = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = model.measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[n]) for n, _ in fields]], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))  # rows without a key are learned from
    model = train(documents.filter(~held))
    return score(documents, model).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
