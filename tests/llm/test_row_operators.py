"""Operators that judge each text on its own: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T

from foliospark.llm import bytebpe, licenses, media, quality_rules
from foliospark.llm.bytebpe import load as load_bytes

LONG = "Ein sehr langer Text, der weiter geht. " * 3000
MENU = "Home | About | News | Contact | Login | Help | Terms | More | Index | Back"
GOOD = "\n".join(" ".join(f"w{(i * 37 + k * 101) % 997}" for k in range(14)).capitalize() + "." for i in range(12))
ROWS = [
    (1, "Some words in a line."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (1, "Some words in a line."), (None, "no key #$%"), (6, "ÀÉ ñandú\r\n　x\x1cy 😀😀"),
    (7, GOOD), (8, GOOD + "\n" + "\n".join([MENU] * 3)), (9, "\n".join([MENU] * 9)), (10, "AAA BBB CCC DDD EEE!! " * 30), (11, "word " * 200), (12, "a b c\n" * 3 + "a b c"),
]
#: Columns of the input that carry the names of results.
CLASH = ["n_words", "kept", "ids", "media", "license", "start", "score"]


def table(spark, rows=ROWS):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
    return spark.createDataFrame([(*r, *CLASH) for r in rows], schema)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def base(t):
    w = words(t)
    lines = [] if t is None else t.split("\n")
    seen, dups = set(), 0
    for line in lines:
        dups += bool(words(line)) and line in seen
        seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dups, len(covered), failed


def test_rules_measure_as_the_plain_version(spark):
    got = quality_rules.score_documents(table(spark)).collect()
    assert len(got) == len(ROWS)
    want = sorted(((k, *base(t)) for k, t in ROWS), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == want
    by = {r.doc_id: r for r in got}
    assert by[7].kept and by[8].kept and not by[9].kept and not by[10].kept and not by[2].kept
    assert by[8].clean_text == GOOD and by[2].clean_text is None and by[7].clean_text == GOOD


def test_rules_keep_all_columns(spark):
    kept = quality_rules.keep_documents(table(spark))
    assert kept.columns == ["doc_id", "text", *CLASH] and [(r.doc_id, r.kept) for r in kept.collect()] == [(7, "kept"), (8, "kept")]
    empty = table(spark, [])
    assert quality_rules.keep_documents(empty).count() == 0 and quality_rules.measures(empty).count() == 0


def test_menu_rule_needs_separators():
    import pyarrow as pa

    fails, _ = quality_rules.failing_lines(pa.array([MENU, "A sentence with a | in it, that goes on.", "LOUD WORDS ARE ALL HERE NOW", "Title", "Done.", "We use cookies to improve.", ""]))
    assert fails.tolist() == [True, False, True, True, False, True, False]


@pytest.mark.parametrize(
    "line",
    ["All rights reserved.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Utilizamos cookies propias.",
     "Datenschutzerklärung und Impressum.", "Politique de confidentialité.", "Política de privacidad.", "Zum Inhalt springen.", "Aller au contenu.", "Saltar al contenido.", "© 2024 Some Site."],
)
def test_boilerplate_of_four_languages(line):
    own = ["Die Rechte der Bürger sind ihm wichtig.", "Il a le droit de rester.", "Los derechos de todos.", "The cookie was sweet."]
    assert quality_rules.failing_lines(pa.array([line, *own]))[0].tolist() == [True, False, False, False, False]


def test_kept_texts_are_cleaned(spark):
    own = "\n".join(" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(9))
    rows = [(1, own + "\nAlle Rechte vorbehalten.\nMenu", 999), (2, own, None), (3, own, 5), (4, None, 1), (5, "", 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in quality_rules.keep_documents(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert got == {1: (own, len(own)), 2: (own, None), 3: (own, 5)}


@pytest.fixture(scope="module")
def reference():
    bpe = load_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_byte_bpe_is_the_library(spark, reference):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = bytebpe.encode_documents(table(spark), *args)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr) == sorted(((k, reference.encode_ordinary(t or "")) for k, t in ROWS), key=repr)
    back = {r.doc_id: bytes(r.decoded) for r in bytebpe.decode_documents(got, *args).collect()}
    assert back == {k: (t or "").encode() for k, t in ROWS}
    digest = {r.doc_id: r for r in bytebpe.digests(table(spark), *args).collect()}
    for k, t in ROWS:
        ids = np.array(reference.encode_ordinary(t or ""), dtype="<u4")
        assert (digest[k].n_tokens, digest[k].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert digest[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bytebpe.digests(table(spark, []), *args).count() == 0


def test_byte_bpe_of_random_texts(reference):
    import random

    import pyarrow as pa

    random.seed(5)
    parts = [" ", "  ", "\n", "\x1c", "\xa0", "a", "aaa", "é", "Σ", "123", "'s", "'S", "!?", "😀", "́", "日本", "ing", "the", " t", "\r\n", "\t", "\x85", " "]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(40))) for _ in range(1500)]
    bpe = load_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, n = bpe.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in media.digests(table(spark)).collect()}
    for k, t in ROWS:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert "bad_crc=0;skipped=0" in r.feature
    assert got[2].media_sha256 == got[3].media_sha256
    made = media.encode_media(table(spark))
    found = {r.doc_id: r for r in media.media_features(made).collect()}
    assert all(len(r.seek_offsets) == r.n_frames and r.samples == 1152 * r.n_frames for r in found.values())
    assert media.digests(table(spark, [])).count() == 0


def test_media_parser_survives_damage(spark):
    payload = bytes(range(256)) * 9
    good = media.encode(media.pad(payload), len(payload))
    whole = media.parse(good)
    assert whole.declared_frames == len(whole.offsets) and media.decode(good, whole).startswith(payload)
    second = whole.offsets[1]
    lost = media.parse(good[:second] + b"\xff\xfb\x00junk\xff" + good[second:])
    assert len(lost.offsets) == len(whole.offsets) and lost.skipped == 8
    flipped = bytearray(good)
    flipped[second + 6] ^= 1
    assert media.parse(bytes(flipped)).bad_checksums == 1
    assert len(media.parse(good[:-5]).offsets) == len(whole.offsets) - 1
    assert media.parse(b"").offsets == [] and media.parse(b"\xff" * 50).offsets == []
    rows = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"abc"))], "doc_id int, media binary")
    assert [(r.kind, r.n_frames) for r in media.media_features(rows).collect()] == [(None, 0)] * 3


def test_media_with_tag_in_the_last_frame():
    for units in (1, 2, 5):
        for at in range(576 * units - 128, 576 * units - 3):
            payload = bytearray(b"a" * 576 * units)
            payload[at : at + 3] = b"TAG"
            made = media.encode(bytes(payload), len(payload))
            found = media.parse(made)
            assert media.decode(made, found) == payload and found.skipped == 0 and "TAG" not in found.tags
            tagged = made + b"TAG" + b"Title".ljust(125, b"\0")
            found = media.parse(tagged)
            assert media.decode(tagged, found) == payload and found.skipped == 0 and found.tags["TAG"] == "Title"
    found = media.parse(made[:-100] + b"TAG" + b"Title".ljust(125, b"\0"))
    assert len(found.offsets) == units - 1 and found.tags["TAG"] == "Title"


def frames(n, mpeg=b"\xff\xfb\x90\xc0"):
    """Frames of 128 kbit/s, and one that holds a table."""
    length = media.header(int.from_bytes(mpeg, "big")).length
    return [(mpeg + bytes(length - 4)) for _ in range(n)]


def test_media_tables_of_encoders():
    first, *rest = frames(6)
    lame = bytearray(first)
    lame[21:25], lame[25:29], lame[29:33] = b"Info", (1 | 8).to_bytes(4, "big"), (5).to_bytes(4, "big")
    lame[37:41], lame[37 + 21 : 37 + 24] = b"LAME", (576 << 12 | 1000).to_bytes(3, "big")
    p = media.parse(bytes(lame) + b"".join(rest))
    assert (p.declared_frames, len(p.offsets), p.delay, p.padding, p.heard) == (5, 5, 576, 1000, 5 * 1152 - 1576)
    vbri = bytearray(first)
    vbri[36:62] = b"VBRI" + bytes(2) + (1105).to_bytes(2, "big") + bytes(6) + (5).to_bytes(4, "big") + (3).to_bytes(2, "big") + bytes(2) + (2).to_bytes(2, "big") + bytes(2)
    vbri[62:68] = b"abcdef"
    p = media.parse(bytes(vbri) + b"".join(rest))
    assert (p.declared_frames, len(p.offsets), p.delay, p.toc) == (5, 5, 1105, b"abcdef")


def test_media_tags_of_both_versions():
    title, long = "Zoë 日本".encode("utf-16"), "x" * 200
    for version, size in ((3, lambda n: n.to_bytes(4, "big")), (4, lambda n: bytes((n >> s) & 127 for s in (21, 14, 7, 0)))):
        body = b"".join(name + size(len(v)) + b"\0\0" + v for name, v in ((b"TIT2", b"\1" + title), (b"TPE1", b"\0" + long.encode()), (b"TALB", b"\3" + "é".encode() + b"\0"), (b"TXXX", b"\0a\0b")))
        tag = b"ID3" + bytes([version, 0, 0]) + bytes((len(body) >> s) & 127 for s in (21, 14, 7, 0)) + body
        assert media.parse(tag + b"".join(frames(3))).tags == {"TIT2": "Zoë 日本", "TPE1": long, "TALB": "é", "TXXX:a": "b"}


def test_media_sync_needs_a_header_of_the_same_kind():
    good = b"".join(frames(4))
    # a header by chance, where another one of another rate stands at its end
    chance = bytearray(b"\xff\xfb\x90\xc0" + bytes(500))
    chance[417:421] = b"\xff\xfb\x94\xc0"
    p = media.parse(bytes(chance[:430]) + good)
    assert len(p.offsets) == 4 and p.offsets[0] == 430


def test_headers_of_other_layers():
    assert media.header(0xFFFB9044).length == 417 and media.header(0xFFFB9044).channels == 2
    assert media.header(0xFFF38044).samples == 576
    assert media.header(0xFFFBF044) is None and media.header(0xFFEB9044) is None and media.header(0x12345678) is None


NOTICES = [
    (1, "Text before.\nReleased under the MIT License.", [("MIT", "Released under the MIT License.")]),
    (2, "Licensed under CC BY-NC 4.0. More text follows here", [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.")]),
    (3, "He lost his driving license. The license was new.", []),
    (4, None, []),
    (5, "", []),
    (6, "# SPDX-License-Identifier: BSD-3-Clause\ncode", [("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause")]),
    (7, "This work is licensed under the GNU General Public License, version 2. Licensed under the Apache License, Version 2.0.", [("GPL-2.0", None), ("Apache-2.0", None)]),
    (8, LONG + "\nReleased under the MIT License.\n" + LONG, [("MIT", None)]),
    (9, "Licensed under CC BY-NC 3.0.", []),
    (9, "Licensed under CC BY-NC 3.0.", []),
]


def test_licenses(spark):
    got = licenses.find_licenses(table(spark, [n[:2] for n in NOTICES])).collect()
    texts = {k: t for k, t, _ in NOTICES}
    for k, t, want in NOTICES:
        own = sorted((r.start, r.license, r.end) for r in got if r.doc_id == k)
        assert [o[1] for o in own] == [w[0] for w in want], (k, own)
        for (start, _, end), (_, span) in zip(own, want):
            assert span is None or texts[k][start:end] == span
    assert licenses.find_licenses(table(spark, [])).count() == 0


def test_every_wording_is_found_in_texts_and_the_closest_wins():
    """Against brute force over all wordings: whole ones, and ones without a word that doesn't tell, among other sentences."""
    s, rng = licenses.scanner(), random.Random(4)
    for w in s.wordings:
        parts = w.text.split()
        for cut in (None, len(parts) // 2):
            block = " ".join(x for i, x in enumerate(parts) if i != cut or x.lower().strip(".,") in licenses.TELLING or re.search(r"\d", x))
            own = licenses.tokens(block)
            confirmed = [(c[0] / x.n, -x.n, x.license) for x in s.wordings if (c := s.confirm(own, x))]
            before, after = (" ".join(rng.choice("river stone of the and under walked house".split()) for _ in range(rng.randrange(40))) + ". " for _ in "ab")
            for text in (block, before + block + " " + after, before + "İ " + block + "\nİstanbul"):
                found = [f for f in s.scan(text) if f[4] <= len(own)]
                if confirmed:
                    assert min(confirmed)[2] in [f[0] for f in found], (w.text, text)
                    assert s.may_hold(pa.array([text]))[0]
                if cut is None:
                    hit = next(f for f in found if f[0] == w.license)
                    assert text[hit[1] : hit[2]].startswith(block[:20])
    assert not s.may_hold(pa.array(["He lost his house. Walked under 3 trees.", None, ""])).any()


def test_license_scan_of_very_many_notices_is_linear():
    s, names = licenses.scanner(), ["MIT License", "Apache License 2.0", "ISC License", "BSD 3-Clause License"]
    began = time.time()
    text = " ".join(f"Released under the {names[i % 4]}." for i in range(5000))
    found = s.scan(text)
    assert len(found) == 5000 and time.time() - began < 60
    assert [f[0] for f in found[:4]] == ["MIT", "Apache-2.0", "ISC", "BSD-3-Clause"]
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))


def test_license_offsets_where_lower_casing_changes_lengths():
    text = "İİ Licensed under the MIT License İ. Licensed under CC0 1.0."
    assert [(f[0], text[f[1] : f[2]]) for f in licenses.scanner().scan(text)] == [("MIT", "Licensed under the MIT License"), ("CC0-1.0", "Licensed under CC0 1.0.")]


def test_license_after_a_notice_and_sentences_like_licenses():
    s = licenses.scanner()
    mit = next(w.text for w in s.wordings if w.license == "MIT" and w.n > 40)
    between = "The software is provided to any person subject to the terms of this license and the conditions that follow. You may use and copy the software. "
    for tail in ("Licensed under CC0 1.0.",):
        alone = [f[0] for f in s.scan(tail)]
        assert alone == ["CC0-1.0"]
        for text in (f"{mit} {between * 3}{tail}", f"{between * 3}{tail} {between * 3}{mit}", f"{between * 3}{tail}"):
            found = [(f[0], text[f[1] : f[2]]) for f in s.scan(text)]
            assert ("CC0-1.0", tail) in found and len(found) == 1 + (mit in text), found
