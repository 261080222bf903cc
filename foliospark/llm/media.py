"""MPEG audio columns: writing bytes as Layer III frames, and reading frames, tags and seek tables back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import array, narrow, slices

#: Bytes of payload in a frame; the fill byte; MPEG-1 Layer III, one channel, 44100 Hz, 192 kbit/s.
UNIT, FILL = 576, 255
RATE, BITRATE, SAMPLES, SIDE = 44100, 192, 1152, 17
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    """What the four bytes at the start of a frame say."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    channels: int
    side: int


def header(word: int) -> Header | None:
    """The header in 32 bits, or None if they are none (no sync, reserved fields, free format)."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = (word >> 19) & 3, 4 - ((word >> 17) & 3)
    bits, rate, pad = (word >> 12) & 15, (word >> 10) & 3, (word >> 9) & 1
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    mpeg1 = version == 3
    kbps, hz = BITRATES[1 if mpeg1 else 2, layer][bits], RATES[version][rate]
    if layer == 1:
        samples, length = 384, (12_000 * kbps // hz + pad) * 4
    else:
        samples = 1152 if layer == 2 or mpeg1 else 576
        length = samples // 8 * 1000 * kbps // hz + pad
    mono = (word >> 6) & 3 == 3
    side = ((17 if mono else 32) if mpeg1 else (9 if mono else 17)) if layer == 3 else 0
    return Header(1 if mpeg1 else 2, layer, not (word >> 16) & 1, kbps, hz, length, samples, 1 if mono else 2, side)


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """The checksum of a protected frame: over the last two header bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    return c


def _word(padding: int, protected: bool) -> bytes:
    bits = BITRATES[1, 3].index(BITRATE)
    return (0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | bits << 12 | padding << 9 | 3 << 6).to_bytes(4, "big")


def _prefix(padding: int) -> bytes:
    h = _word(padding, True)
    return h + crc16(h[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)


_PREFIX = np.frombuffer(_prefix(0) + _prefix(1), dtype=np.uint8).reshape(2, -1)
_HEAD = _PREFIX.shape[1]
_SHORT = SAMPLES // 8 * 1000 * BITRATE // RATE


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload, a positive multiple of 576 bytes, as a tagged file of frames with a table for seeking.

    Frames have the padding bit where the exact bit rate asks for it. Side information says that no bits are
    Huffman data, so that every byte after it is ancillary: players hear silence and the payload is untouched.
    """
    k = len(payload) // UNIT
    exact = np.arange(k + 1, dtype=np.int64) * (SAMPLES // 8 * 1000 * BITRATE) // RATE
    lengths = np.diff(exact)
    padding = lengths - _SHORT
    frames = np.zeros((k, _SHORT + 1), dtype=np.uint8)
    frames[:, :_HEAD] = _PREFIX[padding]
    frames[:, _HEAD : _HEAD + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(k, UNIT)
    body = frames[np.arange(_SHORT + 1) < lengths[:, None]].tobytes()
    toc = bytes(np.minimum(255, exact[np.arange(100) * k // 100] * 256 // max(1, exact[-1])).astype(np.uint8))
    table = b"Xing" + (7).to_bytes(4, "big") + k.to_bytes(4, "big") + (_SHORT + len(body)).to_bytes(4, "big") + toc
    first = (_word(0, False) + bytes(SIDE) + table).ljust(_SHORT, b"\0")
    value = b"\0payload\0" + str(n_bytes).encode()
    tag = b"TXXX" + len(value).to_bytes(4, "big") + b"\0\0" + value
    size = len(tag)
    lead = b"ID3\3\0\0" + bytes((size >> s) & 127 for s in (21, 14, 7, 0)) + tag
    return lead + first + body


@dataclass
class Parsed:
    """What a file holds: tags, frame offsets and lengths, exact length in samples, and what was wrong with it."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    bitrates: set[int] = field(default_factory=set)
    bad_checksums: int = 0
    skipped: int = 0
    declared_frames: int | None = None
    toc: bytes = b""
    delay: int = 0
    padding: int = 0

    @property
    def heard(self) -> int:
        """Samples without those that the encoder put before and after the sound, where the file says how many."""
        return max(0, self.samples - self.delay - self.padding)


_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _text(body: bytes) -> list[str]:
    """The strings of a tag's frame, whose first byte names their encoding."""
    if not body or body[0] > 3:
        return [body.decode("latin-1")]
    name, raw = _ENCODINGS[body[0]], body[1:]
    if body[0] in (1, 2):
        parts, at = [], 0
        for i in range(0, len(raw) - 1, 2):
            if raw[i : i + 2] == b"\0\0":
                parts.append(raw[at:i])
                at = i + 2
        parts.append(raw[at:])
    else:
        parts = raw.split(b"\0")
    return [p.decode(name, "replace").lstrip("\ufeff") for p in parts]


def _tags(media: bytes, end: int) -> dict[str, str]:
    """Frames of an ID3 tag of version 2.3 or 2.4, in which sizes have seven bits a byte; the last of several strings is the value, the others name it."""
    out, at, seven = {}, 10, media[3] >= 4
    while at + 10 <= end and media[at : at + 4].strip(b"\0"):
        raw = media[at + 4 : at + 8]
        length = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0))) if seven else int.from_bytes(raw, "big")
        name, body = media[at : at + 4].decode("latin-1"), media[at + 10 : min(end, at + 10 + length)]
        parts = _text(body) if name[0] in "TW" else [body.decode("latin-1")]
        while len(parts) > 1 and not parts[-1] and name != "TXXX":
            parts.pop()
        out[":".join([name, *[p for p in parts[:-1] if p]])] = parts[-1]
        at += 10 + length
    return out


def parse(media: bytes) -> Parsed:
    """Walk the frames. Lost sync is regained at the next header that a header of the same version, layer and rate, or the end, follows.

    The first frame may hold a Xing or Info table, with the encoder's delay and padding after it, or a VBRI table; it is no sound then.

    Frames cut off by the end of the file don't count. TAG 128 bytes before the end begins a tag only if no frame that ends with the file holds it.
    Empty bytes give no frames.
    """
    out, n, pos = Parsed(), len(media), 0
    if media[:3] == b"ID3" and n >= 10:
        size = (media[6] & 127) << 21 | (media[7] & 127) << 14 | (media[8] & 127) << 7 | (media[9] & 127)
        pos = min(n, 10 + size)
        out.tags = _tags(media, pos)
    tail = n - 128 if n >= 128 and media[n - 128 : n - 125] == b"TAG" else n  # a tag, or bytes of a frame that ends with the file
    seen: dict[bytes, Header | None] = {}
    checked: dict[bytes, int] = {}

    def at_(p: int) -> Header | None:
        key = media[p : p + 4]
        if len(key) < 4 or p + 4 > n:
            return None
        if key not in seen:
            seen[key] = header(int.from_bytes(key, "big"))
        return seen[key]

    def same(a: Header, b: Header | None) -> bool:
        return b is not None and (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)

    synced = False
    while pos + 4 <= n:
        if pos == tail:
            out.tags["TAG"] = media[pos + 3 : pos + 33].rstrip(b"\0 ").decode("latin-1")
            break
        h = at_(pos)
        end = pos + h.length if h is not None else 0
        if h is not None and end <= n and not pos < tail < end < n and (synced or end in (tail, n) or same(h, at_(end))):
            synced = True
            if out.first is None:
                out.first = h
                p = pos + 4 + h.side
                if media[p : p + 4] in (b"Xing", b"Info"):
                    flags, p = int.from_bytes(media[p + 4 : p + 8], "big"), p + 8
                    if flags & 1:
                        out.declared_frames, p = int.from_bytes(media[p : p + 4], "big"), p + 4
                    p += 4 * (flags >> 1 & 1)
                    if flags & 4:
                        out.toc, p = media[p : p + 100], p + 100
                    p += 4 * (flags >> 3 & 1)
                    if media[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= end:
                        gap = int.from_bytes(media[p + 21 : p + 24], "big")
                        out.delay, out.padding = gap >> 12, gap & 0xFFF
                    pos += h.length
                    continue
                p = pos + 36
                if media[p : p + 4] == b"VBRI" and p + 26 <= end:
                    number = lambda at, size: int.from_bytes(media[p + at : p + at + size], "big")
                    out.delay, out.declared_frames = number(6, 2), number(14, 4)
                    out.toc = media[p + 26 : min(end, p + 26 + number(18, 2) * number(22, 2))]
                    pos += h.length
                    continue
            if h.protected and h.layer == 3:
                covered = media[pos + 2 : pos + 6 + h.side]
                if covered not in checked:
                    checked[covered] = crc16(covered[:2] + covered[4:]) == int.from_bytes(covered[2:4], "big")
                out.bad_checksums += not checked[covered]
            out.offsets.append(pos)
            out.lengths.append(h.length)
            out.samples += h.samples
            out.bitrates.add(h.bitrate)
            pos += h.length
        else:
            synced = False
            stop = tail if pos < tail else n
            nxt = media.find(b"\xff", pos + 1, stop)
            nxt = stop if nxt < 0 else nxt
            out.skipped += nxt - pos
            pos = nxt
    return out


def decode(media: bytes, parsed: Parsed) -> bytes:
    """The payload that ``encode`` put into the frames."""
    if not parsed.offsets:
        return b""
    at = np.asarray(parsed.offsets, dtype=np.int64)[:, None] + _HEAD + np.arange(UNIT)
    return np.frombuffer(media, dtype=np.uint8)[at].tobytes()


def features(media: bytes, p: Parsed) -> str:
    """Exact duration, rates, checks, and the seek table as the crc32 of its frame offsets."""
    seek = zlib.crc32(np.asarray(p.offsets, dtype="<u4").tobytes())
    f = p.first
    kind = f"mpeg{f.version}/{f.layer} {f.channels}ch {f.rate}Hz" if f else "none"
    kbps = f"{min(p.bitrates)}-{max(p.bitrates)}" if p.bitrates else "0"
    return (
        f"{kind};kbps={kbps};frames={len(p.offsets)};declared={p.declared_frames};duration={p.heard}/{f.rate if f else 1}s;"
        f"bad_crc={p.bad_checksums};skipped={p.skipped};tags={len(p.tags)};toc={zlib.crc32(p.toc):08x};seek={seek:08x}"
    )


FEATURES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("n_frames", T.LongType()),
        T.StructField("samples", T.LongType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("heard", T.LongType()),
        T.StructField("bad_checksums", T.LongType()),
        T.StructField("skipped_bytes", T.LongType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seek_offsets", T.ArrayType(T.LongType())),
    ]
)


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key of every row and ``media``, its text's bytes as MPEG audio. A null text counts as empty."""
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            media = [encode(pad(raw), len(raw)) for raw in raws(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """For every row its key and the columns of FEATURES of its MPEG bytes.

    Null and empty bytes, and bytes without a frame, have kind null, no frames and no offsets. Rows are read on their own:
    repeated rows give equal rows.
    """
    source = narrow(df, key=key, media=media)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *FEATURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64())]
        for batch in slices(batches):
            rows = []
            for raw in batch.column(1).to_pylist():
                p = parse(bytes(raw or b""))
                kind = f"mpeg{p.first.version}/{p.first.layer}" if p.first else None
                rows.append((kind, len(p.offsets), p.samples, p.first.rate if p.first else None, p.heard, p.bad_checksums, p.skipped, list(p.tags.items()), p.offsets))
            cols = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=schema.names)

    return source.mapInArrow(run, schema)


def pad(raw: bytes) -> bytes:
    """The bytes, filled up to a positive multiple of 576."""
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, bytes([FILL]))


def raws(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in array(texts).cast(pa.binary()).to_pylist()]


DIGEST = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text stored as MPEG audio and read back: the key and the columns of DIGEST. No shuffle.

    Encoding and reading back run in one pass, so that the media needn't be kept; ``encode_media`` gives the bytes.
    """
    source = narrow(df, key=key, text=text)
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *DIGEST.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches):
            rows = []
            for raw in raws(batch.column(1)):
                media = encode(pad(raw), len(raw))
                p = parse(media)
                back = decode(media, p)
                n = int(p.tags["TXXX:payload"])
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(media, p)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=schema.names)

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
