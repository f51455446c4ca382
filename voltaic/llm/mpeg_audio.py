"""MPEG audio columns: a frame writer that stores bytes, and a reader of headers, tags, seek tables and checksums.

The writer stores bytes as the main data of MPEG-1 Layer III frames (44.1 kHz, mono, variable bit rate, CRC on) behind
an ID3v2 tag and a Xing frame with its table. The reader takes any MPEG 1, 2 or 2.5 stream of Layers I to III: it skips
tags, finds the first header that another follows, goes from frame to frame, searches again where a header fails, checks
CRCs, and gives exact durations as samples over rate, with every frame's offset.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import extended, utf8, without

#: Fixed values of the format: kbit/s by (version 1?, layer) and index 1 to 14, Hz of MPEG 1 by index.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
#: Fixed values of Layer II: (subbands, bits of a subband's allocation) of the four tables of MPEG 1 and that of MPEG 2.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "mpeg2": ((4, 4), (7, 3), (19, 2))}
#: Bytes before the main data of a mono Layer III frame with CRC: header, CRC, side information.
SIDE = 17
OVERHEAD = 4 + 2 + SIDE


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    bitrate: int
    rate: int
    mono: bool
    crc: bool
    length: int
    samples: int

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The header in four bytes, or None if they are none (free format and reserved values are none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get(word[1] >> 3 & 3)
    layer, index, rate = 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbit, hz = BITRATES[version == 1.0, layer][index - 1], int(RATES[rate] / {1.0: 1, 2.0: 2, 2.5: 4}[version])
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1.0 else 1152
    padding = word[2] >> 1 & 1
    length = (12000 * kbit // hz + padding) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + padding
    return Header(version, layer, kbit, hz, word[3] >> 6 == 3, not word[1] & 1, length, samples)


@cache
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        x = i << 8
        for _ in range(8):
            x = (x << 1 ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return tuple(out)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    table, x = _crc_table(), 0xFFFF
    for b in data:
        x = (x << 8 & 0xFFFF) ^ table[x >> 8 ^ b]
    return x


def _crc_bits(data: bytes, bits: int) -> int:
    """crc16 of the first bits of data."""
    x = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        x = (x << 1 ^ 0x8005 if (x >> 15) ^ (data[i // 8] >> (7 - i % 8) & 1) else x << 1) & 0xFFFF
    return x


def _layer2_widths(h: Header) -> list[int]:
    """Bits of each subband's allocation."""
    per = h.bitrate // (1 if h.mono else 2)
    if h.version != 1.0:
        table = "mpeg2"
    elif per <= 48:
        table = "d" if h.rate == 32000 else "c"
    else:
        table = "a" if h.rate == 48000 or per <= 80 else "b"
    return [bits for many, bits in ALLOCATIONS[table] for _ in range(many)]


def _protected(h: Header, frame: bytes) -> int:
    """How many bits behind the CRC of a Layer I or II frame it covers: allocations and, in Layer II, two for each channel of a subband that has one."""
    widths = [4] * 32 if h.layer == 1 else _layer2_widths(h)
    channels, joint = 1 if h.mono else 2, frame[3] >> 6 == 1
    bound = min(len(widths), 4 * (frame[3] >> 4 & 3) + 4) if joint else len(widths)
    if h.layer == 1:
        return 4 * (bound * channels + len(widths) - bound)
    body, at, chosen = int.from_bytes(frame[6:38], "big"), 0, 0
    for band, bits in enumerate(widths):
        own = [body >> (256 - at - (c + 1) * bits) & ((1 << bits) - 1) for c in range(channels if band < bound else 1)]
        at += bits * len(own)
        chosen += sum(x > 0 for x in own) * (channels if band >= bound else 1)
    return at + 2 * chosen


def crc_good(h: Header, frame: bytes) -> bool:
    """Does the frame's CRC, if the header says that it has one, fit what it protects?"""
    bits = 8 * side_length(h) if h.layer == 3 else _protected(h, frame)
    data = frame[2:4] + frame[6 : 6 + (bits + 7) // 8]
    return 8 * len(data) >= 16 + bits and _crc_bits(data, 16 + bits) == int.from_bytes(frame[4:6], "big")


def side_length(h: Header) -> int:
    return (17 if h.mono else 32) if h.version == 1.0 else (9 if h.mono else 17)


def _side(n: int) -> bytes:
    """Side information of a mono frame whose two granules hold n bytes of main data."""
    first = min(8 * n, 4095)
    bits = first << (59 + 47) | (8 * n - first) << 47
    return bits.to_bytes(SIDE, "big")


def _frame(kbit_index: int, main: bytes, n: int) -> bytes:
    head = bytes((0xFF, 0xFA, kbit_index << 4, 0xC0))
    side = _side(n)
    body = head + crc16(head[2:] + side).to_bytes(2, "big") + side + main
    return body + bytes(header(head).length - len(body))


@cache
def _capacities() -> tuple[int, ...]:
    return tuple(header(bytes((0xFF, 0xFA, i << 4, 0xC0))).length - OVERHEAD for i in range(1, 15))


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(payload: bytes) -> bytes:
    """payload as a stream of frames; read() gives it back."""
    caps = _capacities()
    most = caps[-1]
    frames = [_frame(14, payload[i : i + most], most) for i in range(0, len(payload) - most + 1, most)]
    if rest := payload[len(frames) * most :]:
        frames.append(_frame(next(i for i, c in enumerate(caps, 1) if c >= len(rest)), rest, len(rest)))
    index = next(i for i, c in enumerate(caps, 1) if c >= 120)
    size = sum(map(len, frames)) + header(bytes((0xFF, 0xFA, index << 4, 0xC0))).length
    offsets, at = [], size - sum(map(len, frames))
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, offsets[len(offsets) * i // 100] * 256 // size) if offsets else 0 for i in range(100))
    xing = b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + size.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    note = b"\x03payload_crc32\x00" + b"%08x" % zlib.crc32(payload)
    tag = b"TXXX" + _synchsafe(len(note)) + b"\x00\x00" + note
    return b"ID3\x04\x00\x00" + _synchsafe(len(tag)) + tag + _frame(index, xing, 0) + b"".join(frames)


@dataclass
class Stream:
    """What a media value holds. seek: the offset of every audio frame; main: where main data lies, for read()."""

    rate: int = 0
    samples: int = 0
    seek: list[int] = field(default_factory=list)
    bitrates: set[int] = field(default_factory=set)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    crc_checked: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    main: list[tuple[int, int]] = field(default_factory=list)

    @property
    def duration(self) -> float:
        return self.samples / self.rate if self.rate else 0.0


def _id3(media: bytes, out: Stream) -> int:
    """Where the audio starts behind ID3v2 tags; their text frames go to out.tags."""
    at = 0
    while media[at : at + 3] == b"ID3" and len(media) >= at + 10:
        major, flags, size = media[at + 3], media[at + 5], int.from_bytes(media[at + 6 : at + 10], "big")
        size = (size >> 24 & 0x7F) << 21 | (size >> 16 & 0x7F) << 14 | (size >> 8 & 0x7F) << 7 | size & 0x7F
        body, p = media[at + 10 : at + 10 + size], 0
        if flags & 0x40 and len(body) >= 4:
            p = int.from_bytes(body[:4], "big") + (4 if major == 3 else 0)
        while major >= 3 and p + 10 <= len(body) and body[p] != 0:
            n = int.from_bytes(body[p + 4 : p + 8], "big")
            if major == 4:
                n = (n >> 24 & 0x7F) << 21 | (n >> 16 & 0x7F) << 14 | (n >> 8 & 0x7F) << 7 | n & 0x7F
            name, value = body[p : p + 4].decode("latin-1"), body[p + 10 : p + 10 + n]
            if name[0] == "T" and value:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
                parts = value[1:].decode(code, "replace").rstrip("\x00").split("\x00")
                out.tags[f"TXXX:{parts[0]}" if name == "TXXX" else name] = parts[-1]
            p += 10 + n
        at += 10 + size + (10 if flags & 0x10 else 0)
    return at


def _table(frame: bytes, h: Header, out: Stream) -> bool:
    """Is this first frame a variable-bit-rate table instead of sound? Then it is kept."""
    at = 4 + (2 if h.crc else 0) + side_length(h)
    for at in {at, 4 + side_length(h)}:
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            out.vbr, flags, at = frame[at : at + 4].decode(), int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            for bit, name in ((1, "vbr_frames"), (2, "vbr_bytes")):
                if flags & bit:
                    setattr(out, name, int.from_bytes(frame[at : at + 4], "big"))
                    at += 4
            if flags & 4:
                out.toc = list(frame[at : at + 100])
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        entries, scale, width = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58))
        out.toc = [scale * int.from_bytes(frame[i : i + width], "big") for i in range(62, min(len(frame), 62 + entries * width), max(width, 1))]
        return True
    return False


def parse(media: bytes) -> Stream:
    """Everything about a media value; bytes that are no audio give an empty stream with all of them skipped."""
    out = Stream()
    at, end = _id3(media, out), len(media)
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", media[end + 3 : end + 33].decode("latin-1").rstrip("\x00 "))
    first: Header | None = None
    synced, started = False, False
    while at + 4 <= end:
        h = header(media[at : at + 4])
        good = h is not None and at + h.length <= end and (first is None or h.like(first))
        if good and not synced:  # a find counts only if a like header or the end follows
            after = header(media[at + h.length : at + h.length + 4]) if at + h.length + 4 <= end else None
            good = at + h.length == end or after is not None and after.like(h)
        if not good:
            if synced:
                out.resyncs += 1
            synced = False
            nxt = media.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        synced, first = True, first or h
        frame_at, at = at, at + h.length
        if h.crc:
            out.crc_checked += 1
            out.crc_bad += not crc_good(h, media[frame_at:at])
        if not started:
            started = True
            out.rate = h.rate
            if h.layer == 3 and _table(media[frame_at:at], h, out):
                continue
        out.seek.append(frame_at)
        out.bitrates.add(h.bitrate)
        out.samples += h.samples
        if h.layer == 3 and h.version == 1.0 and h.mono:
            head = frame_at + (6 if h.crc else 4)
            bits = int.from_bytes(media[head : head + SIDE], "big")
            out.main.append((head + SIDE, ((bits >> 106 & 0xFFF) + (bits >> 47 & 0xFFF)) // 8))
    if at < end:
        out.skipped += end - at
    return out


def read(media: bytes, stream: Stream | None = None) -> bytes:
    """The bytes that write() stored, from what the frames say of their main data."""
    return b"".join([media[a : a + n] for a, n in (stream or parse(media)).main])


FIELDS = "sample_rate int, samples long, duration double, seek array<long>, tags map<string,string>, vbr string, vbr_frames long, toc array<int>, crc_checked int, crc_bad int, resyncs int, skipped long"


def describe(df: DataFrame, column: str = "media") -> DataFrame:
    """df with FIELDS of its media column: exact sample counts, durations, and each frame's offset for seeking.

    Null and empty media, and bytes without two frames in a row, have no frames and 0 samples. Columns of these names
    are replaced, others pass through; each row is worked on by itself.
    """
    df = without(df, *[x.split()[0] for x in FIELDS.split(", ")])
    schema = extended(df, FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [parse(x or b"") for x in batch.column(column).to_pylist()]
            cols = [
                pa.array([x.rate for x in own], pa.int32()), pa.array([x.samples for x in own], pa.int64()), pa.array([x.duration for x in own], pa.float64()), pa.array([x.seek for x in own], pa.list_(pa.int64())),
                pa.array([list(x.tags.items()) for x in own], pa.map_(pa.string(), pa.string())), pa.array([x.vbr for x in own], pa.string()), pa.array([x.vbr_frames for x in own], pa.int64()), pa.array([x.toc for x in own], pa.list_(pa.int32())),
                pa.array([x.crc_checked for x in own], pa.int32()), pa.array([x.crc_bad for x in own], pa.int32()), pa.array([x.resyncs for x in own], pa.int32()), pa.array([x.skipped for x in own], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema.names)

    return df.mapInArrow(run, schema)


def stored(docs: DataFrame) -> DataFrame:
    """Per document its text as an MPEG stream, read back: the contract's digests and a feature string.

    Null and empty texts are stored as 64 zero bytes; texts of any length whole; repeated rows and null doc_ids stay; an
    empty table gives an empty result; further columns are not read.
    """
    ddl = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column("text")):
                media = write(text + bytes(-len(text) % 64 if text else 64))
                stream = parse(media)
                back = read(media, stream)
                seek = xxhash.xxh64_hexdigest(",".join(map(str, stream.seek)).encode(), 0)
                toc = "ok" if stream.vbr_frames == len(stream.seek) and stream.vbr_bytes == len(media) - _id3(media, Stream()) else "bad"
                feature = f"frames={len(stream.seek)};rate={stream.rate};samples={stream.samples};seconds={stream.duration:.6f};kbps={min(stream.bitrates)}-{max(stream.bitrates)};crc={stream.crc_checked - stream.crc_bad}/{stream.crc_checked};table={toc};resyncs={stream.resyncs};seek={seek}"
                rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = zip(*rows) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(cols, kinds)]], ["doc_id", *[x.split()[0] for x in ddl.split(", ")]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ddl)


def query(spark, documents: DataFrame) -> DataFrame:
    return stored(documents)
