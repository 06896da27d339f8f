"""Media columns as Ogg: samples in, container bytes out, and back with everything verified.

A container holds two logical streams. One carries the samples: 8-bit, one channel, in packets of a
fixed duration, whose granule position counts samples. The other carries an index: for each sample packet
its first sample and checksum, with the same clock. Pages follow RFC 3533: a checksum over the page, lacing
values that give packet lengths, packets that go on over pages, and flags for the first and last page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import bounded_batches, doc_id, keyed

RATE = 48_000
PACKET = 16_384
SAMPLES, INDEX = 1, 2
HEAD = "<4sBBqIIIB"
_SWAP8 = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, zero start, no reflection: zlib's on swapped bits."""
    c = zlib.crc32(data.translate(_SWAP8), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_SWAP8), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return blank[:22] + page_crc(blank).to_bytes(4, "little") + blank[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; the first packet has the first page to itself."""
    out: list[tuple[int, bytes]] = []
    lacing, body, granule, carried = bytearray(), bytearray(), -1, False

    def close(last: bool = False) -> None:
        nonlocal lacing, body, granule
        flags = carried_in | 2 * (not out) | 4 * last
        clock = granule if granule >= 0 else (out[-1][0] if out else 0)
        out.append((clock, _page(serial, len(out), flags, granule, bytes(lacing), bytes(body))))
        lacing, body, granule = bytearray(), bytearray(), -1

    carried_in = 0
    for k, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        done = 0
        while True:
            part = values[: 255 - len(lacing)]
            take = sum(part) if len(part) < 64 else 255 * (len(part) - 1) + part[-1]
            lacing += part
            body += packet[done : done + take]
            done, values = done + take, values[len(part) :]
            carried = bool(values)
            if not carried:
                granule = end
                break
            close()
            carried_in = 1
        if k == 0 or k == len(packets) - 1 or len(lacing) == 255:
            close(k == len(packets) - 1)
            carried_in = 0
    return out


def mux(payload: bytes, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The container of a payload of 8-bit samples."""
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    ends = [min(len(payload), (i + 1) * packet) for i in range(len(parts))]
    samples = [(struct.pack("<8sIHH", b"pw-pcm8\0", rate, 1, 8), 0), *zip(parts, ends, strict=True)]
    index = [(struct.pack("<8sIQ", b"pw-index", rate, len(payload)), 0)]
    index += [(struct.pack("<QII", e - len(p), len(p), zlib.crc32(p)), e) for p, e in zip(parts, ends, strict=True)]
    a, b = pages(SAMPLES, samples), pages(INDEX, index)
    # first pages come first; then by the clock
    rest = sorted([(g, 0, i, p) for i, (g, p) in enumerate(a[1:])] + [(g, 1, i, p) for i, (g, p) in enumerate(b[1:])])
    return a[0][1] + b[0][1] + b"".join(x[-1] for x in rest)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: For each packet the granule position of its page if it is the last that ends there, else None.
    granules: list[int | None] = field(default_factory=list)
    ended: bool = False
    lost: int = 0
    _next: int = 0
    _open: list[bytes] | None = None


@dataclass
class Container:
    streams: dict[int, Stream]
    damaged: int = 0


def demux(data: bytes) -> Container:
    """Logical streams with their packets put together again.

    A page whose checksum or lengths don't hold is counted as damaged and skipped up to the next capture
    pattern; a gap in page numbers drops the packet that was open, and both are counted.
    """
    out, at = Container({}), 0
    while (at := data.find(b"OggS", at)) >= 0:
        if len(data) < at + struct.calcsize(HEAD):
            out.damaged += 1
            break
        _, version, flags, granule, serial, number, crc, count = struct.unpack_from(HEAD, data, at)
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        whole = data[at:end]
        if version or len(lacing) < count or end > len(data) or page_crc(whole[:22] + bytes(4) + whole[26:]) != crc:
            out.damaged += 1
            at += 4
            continue
        s = out.streams.setdefault(serial, Stream())
        if number != s._next:
            s.lost += max(0, number - s._next)
            s._open = None
        s._next = number + 1
        if not flags & 1:
            s.lost += s._open is not None
            s._open = None
        skip = bool(flags & 1) and s._open is None
        place, body, ended = at + 27 + count, s._open or [], []
        for x in lacing:
            body.append(data[place : place + x])
            place += x
            if x < 255:
                if not skip:
                    ended.append(b"".join(body))
                body, skip = [], False
        s._open = body if body and not skip else None
        s.packets += ended
        s.granules += [*[None] * (len(ended) - 1), granule][-len(ended) :] if ended else []
        s.ended |= bool(flags & 4)
        at = end
    return out


def ends_of(granules: list[int | None], durations: list[int]) -> list[int]:
    """The clock at the end of each packet: a page's granule position is that of the last packet that ends on it.

    For packets before it on the page the durations of those that follow are taken off.
    """
    out, clock = [0] * len(durations), 0
    for i in range(len(durations) - 1, -1, -1):
        clock = clock if granules[i] is None else granules[i]
        out[i] = clock
        clock -= durations[i]
    return out


def samples_of(data: bytes) -> tuple[bytes, dict[str, float]]:
    """The payload of a container and its clock; ValueError if anything does not hold."""
    c = demux(data)
    if c.damaged or SAMPLES not in c.streams or INDEX not in c.streams or any(s.lost or not s.ended for s in c.streams.values()):
        raise ValueError("damaged container")
    s, index = c.streams[SAMPLES], c.streams[INDEX]
    magic, rate, channels, bits = struct.unpack("<8sIHH", s.packets[0])
    _, index_rate, total = struct.unpack("<8sIQ", index.packets[0])
    if (magic, channels, bits, index_rate) != (b"pw-pcm8\0", 1, 8, rate):
        raise ValueError("unknown stream")
    durations = [0, *map(len, s.packets[1:])]
    ends = ends_of(s.granules, durations)
    starts = [e - d for e, d in zip(ends, durations, strict=True)]
    if starts != [0, *ends[:-1]] or ends[-1] != total or ends_of(index.granules, durations) != ends:
        raise ValueError("granule positions differ from the samples")
    for start, p, entry in zip(starts[1:], s.packets[1:], index.packets[1:], strict=True):
        if struct.unpack("<QII", entry) != (start, len(p), zlib.crc32(p)):
            raise ValueError("index and samples differ")
    pages = sum(g is not None for g in s.granules)
    return b"".join(s.packets[1:]), {"rate": rate, "seconds": ends[-1] / rate, "packets": len(s.packets) - 1, "pages": pages, "last_start": starts[-1] / rate, "longest": max(durations) / rate}


def features(payload: bytes, clock: dict[str, float]) -> str:
    """Duration, packets, start of the last and length of the longest, mean, deviation, crossings of the mean a second, entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    spread = float(counts @ (values - mean) ** 2 / len(x)) ** 0.5
    above = x > mean
    cross = int(np.count_nonzero(above[1:] != above[:-1])) / clock["seconds"]
    times = f"seconds={clock['seconds']:.6f} packets={clock['packets']} last_start={clock['last_start']:.6f} longest={clock['longest']:.6f}"
    return f"{times} mean={mean:.4f} deviation={spread:.4f} crossings={cross:.2f} entropy={abs(float(-(p * np.log2(p)).sum())):.5f}"


def pad(text: bytes, to: int = 192) -> bytes:
    return text + b" " * (max(to, -(-len(text) // to) * to) - len(text))


def encoded(docs: DataFrame, to: int = 192) -> DataFrame:
    """_id, n_bytes and media: each text as samples in a container (null text: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["_t"].cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(map(len, texts), pa.int64()), pa.array([mux(pad(t, to)) for t in texts], pa.binary())], names=["_id", "n_bytes", "media"])

    bounded_batches(docs.sparkSession)
    return keyed(docs).select("_id", "_t").mapInArrow(run, "_id long, n_bytes long, media binary")


def decoded(media: DataFrame) -> DataFrame:
    """_id and n_bytes of media with what its column media holds; a null or damaged one gives nulls."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        stored = len(data), hashlib.sha256(data).hexdigest()
        try:
            payload, clock = samples_of(data)
        except (ValueError, IndexError, struct.error):
            return None, None, None, *stored, None
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored, features(payload, clock)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*map(one, b["media"].to_pylist()), strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["_id"], b["n_bytes"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["_id", "n_bytes", *names])

    return media.select("_id", "n_bytes", "media").mapInArrow(run, "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    One row for each row of docs (columns doc_id, text), read back from the stored container. Null text
    counts as empty: 192 blanks are stored. Repeated rows give equal rows, very long texts are stored whole;
    no rows, no result.
    """
    out = decoded(encoded(docs))
    return out.select(doc_id(), *(c for c in out.columns if c != "_id"))
