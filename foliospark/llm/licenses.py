"""License notices: blocks that compress well given a license's text, confirmed by exact differences in wording."""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import array, narrow, slices, starts

#: (license, wordings).
TEMPLATES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    )),
    ("Apache-2.0", (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied. See the License for the specific language governing permissions and limitations under the License.",
    )),
    ("GPL-3.0", (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3.", "Released under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    )),
    ("GPL-2.0", (
        "This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    )),
    ("LGPL-3.0", ("This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU LGPL v3.")),
    ("LGPL-2.1", ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the GNU LGPL v2.1.")),
    ("AGPL-3.0", ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU AGPL v3.")),
    ("BSD-3-Clause", (
        "Released under the BSD 3-Clause License.", "Licensed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    ("BSD-2-Clause", (
        "Released under the BSD 2-Clause License.", "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    )),
    ("ISC", (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    )),
    ("MPL-2.0", (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    )),
    ("EPL-2.0", ("Licensed under the Eclipse Public License, version 2.0.",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain.",)),
    ("CC0-1.0", ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal.")),
    ("CC-BY-4.0", ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.")),
    ("CC-BY-SA-4.0", ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")),
    ("CC-BY-NC-4.0", ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.")),
    ("CC-BY-ND-4.0", ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.")),
    ("CC-BY-NC-SA-4.0", ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.")),
    ("CC-BY-NC-ND-4.0", ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.")),
)
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)")
_SENTENCE = re.compile(r"[^\n]*?(?:[.;:!?](?=[ \t\n]|$)|\n|$)")
_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
#: Words in which licenses that read alike differ; a wording with one of them needs it, and none of the others.
TELLING = frozenset("mit apache gnu gpl lgpl agpl lesser affero bsd isc mozilla mpl eclipse cc by nc sa nd cc0 clause attribution sharealike noncommercial noderivatives".split())
_SAME = {"licence": "license", "licenced": "licensed", "licences": "licenses"}


def _word(w: str) -> str:
    """A word as it is compared; nothing for a v or version before a number."""
    return "" if w in ("v", "version") else re.sub(r"(\.0)+$", "", _SAME.get(w, w))


def tokens(text: str) -> list[str]:
    """Lower-case words and numbers; a trailing .0 of a number and a v before one don't count."""
    return [x for w in _TOKEN.findall(text.lower()) if (x := _word(w))]


def places(text: str) -> tuple[list[str], list[int], list[int]]:
    """The tokens of a text, and where each begins and ends in it, also if lower-casing changes lengths."""
    low = text.lower()
    at = None
    if len(low) != len(text):
        parts = [c.lower() for c in text]
        low, at = "".join(parts), [i for i, c in enumerate(parts) for _ in c]
    words, begin, end = [], [], []
    for m in _TOKEN.finditer(low):
        if w := _word(m.group()):
            words.append(w)
            begin.append(m.start() if at is None else at[m.start()])
            end.append(m.end() if at is None else at[m.end() - 1] + 1)
    return words, begin, end


def _telling(words) -> frozenset[str]:
    return frozenset(w for w in words if w in TELLING or w[0].isdigit())


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=parameters, **({"dict_data": zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if raw else {}))


class Wording:
    """One text of a license: its words, those that tell it from others, and a compressor that knows it."""

    def __init__(self, license: str, text: str, differences: int):
        self.license, self.text, self.words = license, text, tokens(text)
        self.telling, self.n = _telling(self.words), len(self.words)
        self.differ = differences * self.n // 100
        self.compressor = _compressor(text.encode())
        plain = sorted(set(self.words) - self.telling, key=lambda w: (-len(w), w))
        # of more plain words than may differ one at least is in every text that has the wording
        count, self.some = 0, []
        for w in plain:
            if count > self.differ:
                break
            self.some.append(w)
            count += self.words.count(w)
        if count <= self.differ:
            self.some = []


class Scanner:
    """Finds the wordings in texts. Every wording is tried wherever enough of its words stand close together; nothing else decides what is looked at."""

    def __init__(self, templates=TEMPLATES, differences: int = 20):
        self.wordings = [Wording(name, text, differences) for name, texts in templates for text in texts]
        self.plain = _compressor(b"")
        self.number = {w: i for i, w in enumerate(sorted({w for x in self.wordings for w in x.words}))}
        self.member = np.zeros((len(self.wordings), len(self.number) + 1), dtype=bool)  # the last column: any other word
        for row, x in zip(self.member, self.wordings):
            row[[self.number[w] for w in x.words]] = True

    def may_hold(self, texts: pa.Array) -> np.ndarray:
        """Which texts can have a wording: all words that tell it, and one of more plain words than may differ. No text with a notice is left out."""
        found: dict[str, np.ndarray] = {}

        def has(word: str) -> np.ndarray:
            if word not in found:
                word_ = "licen" if word.startswith("licens") else word
                found[word] = pc.fill_null(pc.match_substring(lower, word_), False).to_numpy(zero_copy_only=False)
            return found[word]

        lower = pc.utf8_lower(texts)
        out = pc.fill_null(pc.match_substring(lower, "spdx-license-identifier"), False).to_numpy(zero_copy_only=False).copy()
        for w in self.wordings:
            mine = np.ones(len(texts), dtype=bool)
            for word in sorted(w.telling, key=lambda x: (len(x) < 3, x)):
                if not mine.any():
                    break
                mine = mine & has(word)
            if w.some and mine.any():
                mine = mine & np.logical_or.reduce([has(word) for word in w.some])
            out |= mine
        return out

    def saved(self, block: str, wording: Wording) -> float:
        """The share of the compressed size of a block that knowing the wording saves."""
        raw = block.encode()
        return 1 - len(wording.compressor.compress(raw)) / len(self.plain.compress(raw))

    def rank(self, block: str, wordings: list[Wording] | None = None) -> list[tuple[float, Wording]]:
        """Wordings with the share of the block's compressed size that knowing each saves, best first."""
        return sorted(((self.saved(block, w), w) for w in wordings or self.wordings), key=lambda x: (-x[0], x[1].license, x[1].text))

    def confirm(self, words: list[str], wording: Wording) -> tuple[int, int, int] | None:
        """How many words differ from the wording where it fits best, and the words there; None if it isn't that license."""
        n, want = wording.n, wording.words
        longest = difflib.SequenceMatcher(None, words, want, autojunk=False).find_longest_match()
        low = max(0, longest.a - longest.b - n // 10)
        part = words[low : longest.a - longest.b + n + n // 10]
        same = [m for m in difflib.SequenceMatcher(None, part, want, autojunk=False).get_matching_blocks() if m.size]
        if not same:
            return None
        a, b = same[0].a, same[-1].a + same[-1].size
        differ = max(b - a, n) - sum(m.size for m in same)
        if differ > wording.differ or _telling(part[a:b]) != wording.telling:
            return None
        return differ, low + a, low + b

    def spans(self, ids: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """Runs of words, of a bounded length, that may hold wording k: where a span of its length has as many of its words as it needs."""
        w = self.wordings[k]
        inside = starts(self.member[k][ids])
        length = min(len(ids), w.n + w.differ)
        enough = np.flatnonzero(inside[length:] - inside[: len(inside) - length] >= w.n - w.differ)
        if not len(enough):
            return
        for run in np.split(enough, np.flatnonzero(np.diff(enough) > 1) + 1):
            low, high, step = int(run[0]), int(run[-1]) + length, 3 * length
            for at in range(low, high, step):
                yield at, min(high, at + step + length)
                if at + step + length >= high:
                    break

    def scan(self, text: str) -> list[tuple[str, int, int, float, int]]:
        """Findings (license, start, end, saved share, differing words) by place; offsets count code points.

        Of confirmed wordings that overlap, the one with the smallest share of differences stays, the longest of equals, then the one whose
        knowledge saves most.
        """
        words, begin, end = places(text)
        other = len(self.number)
        ids = np.fromiter((self.number.get(w, other) for w in words), dtype=np.int64, count=len(words))
        present, found = set(words), set()
        for k, w in enumerate(self.wordings):
            if not w.telling <= present:
                continue
            for parts in self.spans(ids, k):
                todo = [parts]
                while todo:
                    a, b = todo.pop()
                    if b - a < w.n - w.differ:
                        continue
                    got = self.confirm(words[a:b], w)
                    if got is None:
                        # the longest common run may stand elsewhere: then each sentence of the block on its own
                        for m in _SENTENCE.finditer(text, begin[a], end[b - 1]):
                            x, y = bisect_left(begin, m.start(), a, b), bisect_left(begin, m.end(), a, b)
                            if w.n - w.differ <= y - x < b - a and (one := self.confirm(words[x:y], w)):
                                found.add((k, one[0], x + one[1], x + one[2]))
                        continue
                    found.add((k, got[0], a + got[1], a + got[2]))
                    todo += [(a, a + got[1]), (a + got[2], b)]
        ranked = []
        for k, differ, a, b in found:
            w = self.wordings[k]
            ranked.append((differ / w.n, -w.n, -round(self.saved(text[begin[a] : end[b - 1]], w), 4), a, b, k, differ))
        out, taken, until = [], [], []
        for _, _, saved, a, b, k, differ in sorted(ranked):
            i = bisect_left(until, a + 1)
            if i < len(taken) and taken[i] < b:
                continue
            taken.insert(i, a)
            until.insert(i, b)
            start, stop = begin[a], end[b - 1]
            while stop < len(text) and text[stop] in ".)\"'":
                stop += 1
            out.append((self.wordings[k].license, start, stop, -saved, differ))
        for m in SPDX.finditer(text):
            out.append((m.group(1).rstrip("."), m.start(), m.end(), 1.0, 0))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


@lru_cache(maxsize=4)
def scanner(templates=TEMPLATES, differences: int = 20) -> Scanner:
    return Scanner(templates, differences)


FINDINGS = (("license", T.StringType(), pa.string()), ("start", T.LongType(), pa.int64()), ("end", T.LongType(), pa.int64()), ("saved", T.DoubleType(), pa.float64()), ("differences", T.LongType(), pa.int64()))


def find_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, differences: int = 20) -> DataFrame:
    """A row for each notice found: key, license, start and end in code points, saved, differences.

    At most ``differences`` percent of a wording's words may differ, and none of the words that tell licenses apart. A text without a notice,
    null or empty, gives no row. Repeated rows give equal findings. Whole texts are scanned, in time that grows with their length, and nothing is
    shuffled. Which texts are scanned follows from the wordings: only texts that can't have any are left out.
    """
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *[T.StructField(n, k) for n, k, _ in FINDINGS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(templates, differences)
        for batch in slices(batches):
            texts = array(batch.column(1))
            rows = [(i, *r) for i in np.flatnonzero(found.may_hold(texts)).tolist() for r in found.scan(texts[i].as_py())]
            if rows:
                cols = list(zip(*rows))
                keys = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, (_, _, k) in zip(cols[1:], FINDINGS)]], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
