"""Token ids of a word-level BPE vocabulary, by the tokenizers library, encoding each distinct word once."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytebpe import gather
from .common import Words, array

#: Words that a worker remembers; beyond that it forgets all and starts anew.
CACHE = 600_000
#: Letters for which every Unicode version and library agrees on case, class and composition.
_PLAIN = set(map(chr, [*range(33, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: White space to Python, or to Unicode, that isn't ASCII, and the four separators on which libraries differ.
_ODD = "\x1c\x1d\x1e\x1f"


class WordBpe:
    """A tokenizer file and the ids of the words met so far.

    Its normaliser lower-cases and its pattern never matches across white space, so a text's ids are its words' ids one after
    the other. A word of plain letters goes to the library's model directly, cut as its pattern cuts; any other word
    goes through the library as a whole. A text that holds separators on which libraries differ isn't cut at all.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.direct = self._agrees()

    def _agrees(self) -> bool:
        """Whether the file's steps are those that the direct way repeats; if not, the library does every word."""
        probe = "Don't x2 ÀÉßñ?! <|endoftext|> we'LL 42,a_b (c) ÇA'S"
        own = [w for part in probe.split() for w in self._direct([part])[0]]
        return own == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _direct(self, words: list[str]) -> list[list[int]]:
        cut = [self.find(w.lower()) for w in words]
        raw = lambda p: p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
        return [[t.id for p in parts for t in self.model.tokenize(raw(p))] for parts in cut]

    def learn(self, words: list[str]) -> None:
        known, parts = self.words, self.parts
        plain = [w for w in words if w.isascii() or _PLAIN.issuperset(w)] if self.direct else []
        find, tokenize, letters = self.find, self.model.tokenize, self.letters
        for w in plain:
            ids = []
            for p in find(w.lower()):
                if (got := parts.get(p)) is None:
                    q = p if p.isascii() else p.encode().decode("latin-1").translate(letters)
                    got = parts[p] = np.array([t.id for t in tokenize(q)], dtype="<u4").tobytes()
                ids.append(got)
            known[w] = ids[0] if len(ids) == 1 else b"".join(ids)
        rest = [w for w in words if w not in known]
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has; ``end`` is appended to each. A null text counts as empty."""
        if len(self.words) > CACHE or len(self.parts) > CACHE:
            self.words, self.parts = {}, {}
        texts = array(texts)
        words = Words(texts)
        vocab = words.vocab.to_pylist()
        known = self.words
        new = [w for w in vocab if w not in known]
        self.learn(new)
        ids = [known[w] for w in vocab]
        odd = [i for i, w in enumerate(vocab) if not w.isascii() and unicodedata.combining(w[0])]
        odd += [i for i, w in enumerate(vocab) if not w.isprintable() and any(c in w for c in _ODD)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) >> 2
        values = np.frombuffer(b"".join(ids), dtype="<u4")
        rows = len(texts)
        got, each = gather(lengths, values, words.codes) if len(ids) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        doc = words.docs()
        n = np.bincount(doc, weights=each, minlength=rows).astype(np.int64)
        strange = np.unique(doc[np.isin(words.codes, odd)]) if odd else []
        if len(strange) or end is not None:
            at = np.concatenate([[0], np.cumsum(n)])
            if len(strange):
                parts, begin = [], 0
                for d in strange:
                    parts += [got[begin : at[d]], self.whole(texts[int(d)].as_py())]
                    n[d], begin = len(parts[-1]), at[d + 1]
                got = np.concatenate([*parts, got[begin:]])
                at = np.concatenate([[0], np.cumsum(n)])
            if end is not None:
                out = np.full(len(got) + rows, end, dtype="<u4")
                keep = np.ones(len(out), dtype=bool)
                n += 1
                keep[np.cumsum(n) - 1] = False
                out[keep] = got
                got = out
        return got, n


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One tokenizer per worker and file."""
    return WordBpe(path)
