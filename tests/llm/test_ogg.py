import hashlib
import random
import zlib

import pytest

from pagewright.llm import ogg


def crc_bitwise(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
    return c


def test_page_checksum():
    r = random.Random(1)
    for n in (0, 1, 5, 300):
        data = r.randbytes(n)
        assert ogg.page_crc(data) == crc_bitwise(data)


@pytest.mark.parametrize("n", [1, 192, 254, 255, 256, 510, 16384, 16385, 65025, 65026, 200_000])
@pytest.mark.parametrize("packet", [255, 16384, 100_000])
def test_round_trip(n, packet):
    payload = random.Random(n).randbytes(n)
    data = ogg.mux(payload, packet=packet)
    back, clock = ogg.samples_of(data)
    assert back == payload and clock["seconds"] == n / ogg.RATE and clock["packets"] == -(-n // packet)


def test_damage_is_found_and_skipped():
    payload = random.Random(7).randbytes(300_000)
    data = bytearray(ogg.mux(payload))
    data[150_000] ^= 1
    c = ogg.demux(bytes(data))
    assert c.damaged == 1 and c.streams[ogg.SAMPLES].lost >= 1
    assert all(p in payload for p in c.streams[ogg.SAMPLES].packets[1:])
    with pytest.raises(ValueError):
        ogg.samples_of(bytes(data))
    with pytest.raises(ValueError):
        ogg.samples_of(bytes(data[:1000]))


def test_query_equals_direct_values(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "long " * 50_000, "a"]
    docs = spark.createDataFrame([(i if i else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    out = ogg.query(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        b = (texts[r.doc_id or 0] or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes > len(p) and len(r.media_sha256) == 64 and r.feature
    assert ogg.query(docs.limit(0)).collect() == []
    bad = spark.createDataFrame([(1, 2, b"junk"), (2, 2, None)], "_id long, n_bytes long, media binary")
    assert [(r.payload_bytes, r.media_bytes) for r in ogg.decoded(bad).orderBy("_id").collect()] == [(None, 4), (None, None)]


def test_timestamps_come_from_granule_positions():
    assert ogg.ends_of([0, None, None, 30, 35], [0, 10, 10, 10, 5]) == [0, 10, 20, 30, 35]
    payload = random.Random(5).randbytes(90_000)
    data = ogg.mux(payload)
    s = ogg.demux(data).streams[ogg.SAMPLES]
    assert s.granules.count(None) >= 3  # several packets end on one page
    assert ogg.ends_of(s.granules, [0, *map(len, s.packets[1:])]) == [0, *(min(90_000, 16_384 * (i + 1)) for i in range(6))]
    clock = ogg.samples_of(data)[1]
    assert (clock["last_start"], clock["longest"]) == (16_384 * 5 / ogg.RATE, 16_384 / ogg.RATE)
    at = data.find(b"OggS", data.find(b"OggS", data.find(b"OggS", 1) + 1) + 1)
    at = next(i for i in range(at, len(data)) if data[i : i + 4] == b"OggS" and int.from_bytes(data[i + 6 : i + 14], "little") not in (0, 2**64 - 1))
    size = 27 + data[at + 26] + sum(data[at + 27 : at + 27 + data[at + 26]])
    page = bytearray(data[at : at + size])
    page[6:14] = (int.from_bytes(page[6:14], "little") + 7).to_bytes(8, "little")
    page[22:26] = bytes(4)
    page[22:26] = ogg.page_crc(bytes(page)).to_bytes(4, "little")
    with pytest.raises(ValueError, match="granule"):
        ogg.samples_of(data[:at] + bytes(page) + data[at + size :])
