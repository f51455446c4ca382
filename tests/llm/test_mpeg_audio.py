import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from voltaic.llm import mpeg_audio as m


@pytest.mark.parametrize("n", [0, 1, 64, 81, 82, 1020, 1021, 1022, 2042, 2043, 5000, 100_000])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = m.write(payload)
    s = m.parse(media)
    assert m.read(media) == payload and s.resyncs == s.skipped == s.crc_bad == 0
    assert s.samples == 1152 * len(s.seek) and s.vbr == "Xing" and s.vbr_frames == len(s.seek) and len(s.toc) == 100
    assert s.tags["TXXX:payload_crc32"] == f"{zlib.crc32(payload):08x}" and s.duration == s.samples / 44100


def test_payload_full_of_sync_words():
    payload = b"\xff\xfa\xe0\xc0" * 3000
    media = m.write(payload)
    assert m.read(media) == payload


def test_resynchronises():
    media = m.write(bytes(range(256)) * 40)
    s = m.parse(media)
    cut = s.seek[3]
    broken = media[:cut] + b"junk\xff\xfb" + media[cut:]
    t = m.parse(broken)
    assert t.resyncs == 1 and t.skipped == 6 and len(t.seek) == len(s.seek) and t.seek[3] == cut + 6
    lost = m.parse(media[: s.seek[5]] + media[s.seek[5] + 100 :])
    assert lost.resyncs == 1 and len(lost.seek) == len(s.seek) - 1
    flipped = bytearray(media)
    flipped[s.seek[2] + 7] ^= 1
    assert m.parse(bytes(flipped)).crc_bad == 1


def test_headers():
    h = m.header(b"\xff\xfb\x90\x00")  # MPEG 1 Layer III, 128 kbit/s, 44.1 kHz, stereo
    assert (h.layer, h.bitrate, h.rate, h.length, h.samples, h.mono, h.crc) == (3, 128, 44100, 417, 1152, False, False)
    assert m.header(b"\xff\xfb\x92\x00").length == 418
    assert m.header(b"\xff\xf3\x80\xc0").samples == 576 and m.header(b"\xff\xf3\x80\xc0").rate == 22050
    assert m.header(b"\xff\xe3\x80\xc0").rate == 11025
    one = m.header(b"\xff\xff\x40\x00")  # Layer I
    assert (one.layer, one.length, one.samples) == (1, 12000 * 128 // 44100 * 4, 384)
    for bad in (b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xf9\x90\x00"[:3], b"\xff\xea\x90\x00", b"\x00\xfb\x90\x00", b"\xff\xf8\x90\x00"[:1]):
        assert m.header(bad) is None


def bitwise_crc(bits):
    x = 0xFFFF
    for b in bits:
        x = x << 1 ^ (0x8005 if x >> 15 ^ b else 0)
        x &= 0xFFFF
    return x


def as_bits(data):
    return [x >> i & 1 for x in data for i in range(7, -1, -1)]


#: Header bytes behind the sync byte, and the widths of each subband's allocation by hand; joint stereo has one from its bound on.
FRAMES = [
    (b"\xfe\x40\xc0", [4] * 32, 1, 32), (b"\xfe\x40\x00", [4] * 32, 2, 32), (b"\xfe\x40\x50", [4] * 32, 2, 8),
    (b"\xfc\xa0\x00", [4] * 11 + [3] * 12 + [2] * 7, 2, 30), (b"\xfc\x80\xc0", [4] * 11 + [3] * 12 + [2] * 7, 1, 30), (b"\xfc\x84\xc0", [4] * 11 + [3] * 12 + [2] * 4, 1, 27),
    (b"\xfc\x20\xc0", [4] * 2 + [3] * 6, 1, 8), (b"\xfc\x28\xc0", [4] * 2 + [3] * 10, 1, 12), (b"\xfc\xa0\x60", [4] * 11 + [3] * 12 + [2] * 7, 2, 12), (b"\xf4\x80\x00", [4] * 4 + [3] * 7 + [2] * 19, 2, 30),
]


@pytest.mark.parametrize("head,widths,channels,bound", FRAMES)
@pytest.mark.parametrize("seed", range(4))
def test_checksums_of_layers_1_and_2(head, widths, channels, bound, seed):
    rng = random.Random(seed)
    h = m.header(b"\xff" + head)
    frames = []
    for _ in range(3):
        bits, chosen = [], 0
        for band, w in enumerate(widths):
            for _ in range(channels if band < bound else 1):
                x = rng.choice((0, rng.randrange(1 << w)))
                bits += [x >> i & 1 for i in range(w - 1, -1, -1)]
                chosen += (x > 0) * (1 if band < bound else channels)
        n = len(bits) + (2 * chosen if h.layer == 2 else 0)
        body = bits + [rng.randrange(2) for _ in range(8 * (h.length - 6) - len(bits))]
        crc = bitwise_crc(as_bits(head[1:]) + body[:n])
        frames.append(b"\xff" + head + crc.to_bytes(2, "big") + bytes(int("".join(map(str, body[i : i + 8])), 2) for i in range(0, len(body), 8)))
    s = m.parse(b"".join(frames))
    assert (len(s.seek), s.crc_checked, s.crc_bad, h.layer in (1, 2)) == (3, 3, 0, True)
    flipped = bytearray(b"".join(frames))
    flipped[h.length + 6] ^= 0x80
    assert m.parse(bytes(flipped)).crc_bad == 1


def test_tags_and_tables():
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    v1 = b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    s = m.parse(frame * 3 + v1)
    assert len(s.seek) == 3 and s.tags["TIT2"] == "Title" and s.skipped == 0
    vbri = bytearray(frame)
    vbri[36:40] = b"VBRI"
    vbri[46:54] = (1251).to_bytes(4, "big") + (2).to_bytes(4, "big")
    vbri[54:62] = b"\0\2\0\1\0\2\0\1"
    vbri[62:66] = b"\1\xa1\1\xa1"
    s = m.parse(bytes(vbri) + frame * 2)
    assert (s.vbr, s.vbr_frames, s.vbr_bytes, s.toc, len(s.seek)) == ("VBRI", 2, 1251, [417, 417], 2)
    tag = b"ID3\x03\x00\x00\x00\x00\x00\x0f" + b"TALB\x00\x00\x00\x05\x00\x00" + b"\x00Disc"
    assert m.parse(tag + frame * 2).tags == {"TALB": "Disc"}


@pytest.mark.parametrize("junk", [b"", b"\xff", b"\xff\xfb\x90\x00", b"x" * 1000, b"\xff" * 1000, b"ID3\x04\x00\x00\x7f\x7f\x7f\x7f"])
def test_no_audio(junk):
    s = m.parse(junk)
    assert s.seek == [] and s.samples == 0 and s.duration == 0.0


def test_describe(spark):
    rows = [(1, m.write(b"abc" * 900)), (2, None), (3, b""), (4, b"noise")]
    df = spark.createDataFrame(rows, "k int, media binary").withColumn("Duration", F.lit("old"))
    got = {r.k: r for r in m.describe(df).collect()}
    assert got[1].samples == 1152 * len(got[1].seek) == 1152 * 3 and got[1].sample_rate == 44100 and got[1].tags["TXXX:payload_crc32"]
    assert all(got[k].samples == 0 and got[k].seek == [] for k in (2, 3, 4))
    assert m.describe(df.limit(0)).count() == 0


def test_query(spark, odd, none):
    got = m.query(spark, odd).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    assert len(got) == odd.count()
    for r in got:
        t = texts[r.doc_id]
        p = t + bytes(-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(m.write(p)).hexdigest() and "table=ok" in r.feature
    assert len({r.media_sha256 for r in got if r.doc_id in (1, 2)}) == 1
    assert m.query(spark, none).count() == 0
