"""Repeated byte strings by bucket-pointer refinement of suffix buckets.

Every position starts in the bucket of its q-gram. A bucket is refined by sorting its positions on the bucket
numbers of a later offset of the same suffix: positions that agree in both stay together, and these finer
numbers serve the next refinement in turn (Schuermann and Stoye, 2005). So 64-byte buckets become those of
128 bytes by the numbers at +64, and those of 200 bytes by the refined numbers at +72. A bucket with one
position is done: no longer string there repeats. What is left in the end are the repeats.

A corpus is split by its samples (see _samples): all positions of equal strings lie with the q-gram that
owns the string, so each sample's neighbourhoods are refined apart from all others, on any executor. Bucket
numbers hold inside a task only. The strings of a hot sample, whose positions no one task may gather, are
named instead by a hash of their buckets, which any task finds alike, and grouped by that name. A q-gram's
bucket is known by a 64-bit hash; names of hot strings have 96 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._samples import FLUSH, Held, owners_of, repeated_places, runs, sliced, stretches, with_places
from ._shared import apart, bounded_batches, complete_groups, doc_id, keyed, mix, window_owners

#: A text is worked through in pieces of this many bytes.
PIECE = 1 << 22
#: A sample at more places than this is hot: its strings are dealt out by themselves.
HOT = 2000


def gram_buckets() -> Callable[[np.ndarray, int], np.ndarray]:
    """A function that gives the 64-bit bucket identifier of each q-gram of a byte array."""
    base = 0xD1342543DE82EF95
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    power: list[np.ndarray] = [np.ones(1, np.uint64)] * 2

    def buckets(data: np.ndarray, q: int) -> np.ndarray:
        n = len(data)
        if n < q:
            return np.empty(0, np.uint64)
        if len(power[0]) < n:
            for i, b in enumerate((base, pow(base, -1, 2**64))):
                x = np.full(2 * n, b, np.uint64)
                x[0] = 1
                power[i] = np.cumprod(x, dtype=np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(value[data] * power[0][:n], out=total[1:])
        return mix((total[q:] - total[:-q]) * power[1][: n - q + 1])

    return buckets


def named(bucket: np.ndarray, q: int, length: int) -> np.ndarray:
    """Names of the strings of `length` bytes, from the buckets of their q-grams."""
    ids, reach = bucket, q
    while reach < length:
        step = min(reach, length - reach)
        ids = mix(ids[: len(ids) - step] * np.uint64(0x9FB21C651E98DF25) + ids[step:])
        reach += step
    return ids


def numbered(keys: np.ndarray) -> np.ndarray:
    """The number of each key's bucket in sorted order; -1 for a key that no other equals."""
    order = np.argsort(keys)
    start = np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)]
    number = np.cumsum(start) - 1
    number[np.bincount(number, minlength=1)[number] < 2] = -1
    out = np.empty(len(keys), np.int64)
    out[order] = number
    return out


def refined(grams: np.ndarray, left: np.ndarray, q: int, length: int) -> np.ndarray:
    """Bucket numbers of the strings of `length` bytes at each position; -1 where nothing equals them.

    grams: the buckets of q-grams; left: how many bytes of its own text each position has before it ends.
    """
    bucket = np.full(len(left), -1)
    at = np.flatnonzero(left[: len(grams)] >= q)
    bucket[at] = numbered(grams[at])
    while q < length:
        step = min(q, length - q)
        at = at[(left[at] >= q + step) & (bucket[at] >= 0)]
        at = at[bucket[at + step] >= 0]
        finer = np.full(len(left), -1)
        finer[at] = numbered(bucket[at] * len(left) + bucket[at + step])
        bucket, q = finer, q + step
    return bucket


def repeated_spans(docs: DataFrame, length: int = 200, q: int = 64, hot: int = HOT, flush: int = FLUSH, least: int = 2000) -> DataFrame:
    """_id, _h, s, e: spans of bytes covered by strings of `length` bytes that start at another place too.

    docs comes from keyed(). Spans may overlap. A task holds `flush` strings of hot samples at most, or
    the neighbourhoods of `hot` places beyond a batch.
    """
    q = min(q, length)
    width = length - q + 1

    def pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for c in range(0, len(data) - length + 1, PIECE):
            yield c, data[c : c + PIECE + length - 1]

    def sample_with(buckets: Callable) -> Callable[[bytes], tuple[np.ndarray, np.ndarray]]:
        def sample(text: bytes) -> tuple[np.ndarray, np.ndarray]:
            h, at = [], []
            for c, part in pieces(np.frombuffer(text, np.uint8)):
                g = buckets(part, q)
                owners = window_owners(g, width)
                places = owners[np.r_[True, owners[1:] != owners[:-1]]]
                h.append(g[places])
                at.append(places + c)
            if not h:
                return np.empty(0, np.uint64), np.empty(0, np.int64)
            places, one = np.unique(np.concatenate(at), return_index=True)
            return np.concatenate(h)[one], places

        return sample

    def settled(held: Held) -> Iterator[pa.RecordBatch]:
        """Strings that this task holds twice are spans; others, and one of those, are dealt out."""
        ids, hashes, (no, k, v, s) = held.drain()
        order = np.lexsort((v, k))
        no, k, v, s = (x[order] for x in (no, k, v, s))
        start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        size = np.diff(np.r_[start, len(k)])
        d = no[start]
        yield from sliced(_rows(k[start], v[start], ids[d], hashes[d], s[start], n=np.minimum(size, 2)))
        many = np.repeat(size > 1, size)
        a, z = runs(np.sort(no[many] << 32 | s[many]))
        d = a >> 32
        yield from sliced(_rows(mix(a.view(np.uint64)), np.zeros(len(a), np.int32), ids[d], hashes[d], a & 0xFFFFFFFF, (z & 0xFFFFFFFF) + length))

    def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, buckets = Held(4), set(), gram_buckets()
        for b in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            for doc, text_hash, text, at in zip(b["_id"].to_pylist(), b["_h"].to_pylist(), b["_t"].cast(pa.binary()).to_pylist(), b["at"].to_pylist(), strict=True):
                if (doc, text_hash) in seen:
                    continue
                seen.add((doc, text_hash))
                places = np.array(at, np.int64)
                for c, part in pieces(np.frombuffer(text, np.uint8)):
                    g = buckets(part, q)
                    owners = window_owners(g, width)
                    here = places[(places >> 1 >= c) & (places >> 1 < c + len(part))] - 2 * c
                    s, few = owners_of(owners, len(part), here)
                    if len(s):
                        v = (mix(g[s] ^ g[s + length - q] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                        held.add(doc, text_hash, named(g, q, length)[s], v, s + c)
                    if len(few):
                        a, z = stretches(owners, few)
                        k, first, last = g[owners[few[a]]].view(np.int64).tolist(), (few[a] + c).tolist(), (few[z - 1] + c + length).tolist()
                        rows += [(key, doc, text_hash, i, text[i:j]) for key, i, j in zip(k, first, last, strict=True)]
                    if held.size >= flush:
                        yield from settled(held)
            if rows:
                k, ids, hashes, s, near = zip(*rows, strict=True)
                yield from sliced(_rows(np.array(k, np.int64), np.zeros(len(k), np.int32), np.array(ids, np.int64), np.array(hashes, np.int64), np.array(s, np.int64), n=np.ones(len(k), np.int64), near=near))
        if held.size:
            yield from settled(held)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, buckets = ["_id", "_h", "s", "e"], gram_buckets()
        for t, _ in complete_groups(batches, "k", 2**62, least):
            k, v, i, h, s, e, n = (t[c].to_numpy() for c in ("k", "v", "_id", "_h", "s", "e", "n"))
            lists = t["near"].is_valid().to_numpy()
            yield from t.select(names).filter(pa.array(e > 0)).combine_chunks().to_batches()
            # strings by themselves: two or more, counted over all tasks
            one = np.flatnonzero((e == 0) & ~lists)
            if len(one):
                one = one[np.lexsort((v[one], k[one]))]
                start = np.flatnonzero(np.r_[True, (k[one][1:] != k[one][:-1]) | (v[one][1:] != v[one][:-1])])
                size = np.diff(np.r_[start, len(one)])
                out = one[(np.repeat(np.add.reduceat(n[one], start), size) > 1) & (n[one] == 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i[out], h[out], s[out], (s[out] + length).astype(np.int32))], names=names)
            # neighbourhoods: refine the buckets of all their positions, then sort
            near = t["near"].filter(pa.array(lists)).to_pylist()
            if not near:
                continue
            size = np.fromiter(map(len, near), np.int64, len(near))
            data = np.frombuffer(b"".join(near), np.uint8)
            row = np.repeat(np.arange(len(size)), size)
            within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            # positions of one string that two stretches of a document share can't occur: each has one owner
            found = np.flatnonzero(refined(buckets(data, q), size[row] - within, q, length) >= 0)
            cut = np.flatnonzero((np.diff(found) != 1) | (np.diff(row[found]) != 0))
            a, z = (found[np.r_[0, cut + 1]], found[np.r_[cut, len(found) - 1]]) if len(found) else (found, found)
            i, h, s = i[lists][row[a]], h[lists][row[a]], s[lists][row[a]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, h, (s + within[a]).astype(np.int32), (s + within[z] + length).astype(np.int32))], names=names)

    def sampled(text: bytes, buckets: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  one table of powers a task
        if not buckets:
            buckets.append(sample_with(gram_buckets()))
        return buckets[0](text)

    bounded_batches(docs.sparkSession)
    found = with_places(docs, repeated_places(docs, sampled, hot, flush), "inner")
    found = found.mapInArrow(neighbourhoods, "k long, v int, _id long, _h long, s int, e int, n int, near binary")
    return found.repartition("k").sortWithinPartitions("k").mapInArrow(refine, "_id long, _h long, s int, e int")


def _rows(k, v, ids, hashes, s, e=None, n=None, near=None) -> dict[str, pa.Array]:
    zero = np.zeros(len(k), np.int64)
    as_int = lambda x: pa.array((zero if x is None else x).astype(np.int32))
    return {"k": pa.array(k.view(np.int64)), "v": pa.array(v), "_id": pa.array(ids), "_h": pa.array(hashes), "s": as_int(s), "e": as_int(e), "n": as_int(n), "near": pa.nulls(len(k), pa.binary()) if near is None else pa.array(near, pa.binary())}


def merged(spans: list[int]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs that the spans (start << 32 | end) cover."""
    x = np.sort(np.array(spans, np.int64))
    s, e = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
    cut = np.flatnonzero(s[1:] > e[:-1])
    return s[np.r_[0, cut + 1]].tolist(), e[np.r_[cut, len(e) - 1]].tolist()


def query(docs: DataFrame, length: int = 200, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (columns doc_id, text).

    Each byte goes that a string of `length` bytes covers which also starts anywhere else; strings are
    judged on the input, and none crosses documents. Null text counts as empty. Rows without a doc_id are
    documents of their own; repeated rows (equal doc_id and text) are one document and no repeat of each
    other; different texts with one doc_id are documents of their own too, told apart by 64-bit hashes.
    Shorter texts keep all; very long ones are read in pieces; no rows, no result. A cut may leave part of
    a UTF-8 character: bytes are judged, not characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b["_t"].cast(pa.binary()).to_pylist(), b["at"].to_pylist(), strict=True):
                a, z = merged(spans) if spans else ([], [])
                sha = hashlib.sha256()
                for i, j in zip([0, *z], [*a, len(text)], strict=True):
                    sha.update(text[i:j])
                rows.append((len(text), sum(z) - sum(a), len(a), sha.hexdigest()))
            n, gone, count, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b["_id"], *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(sha, pa.string())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = apart(keyed(docs))
    found = repeated_spans(rows, length, **options).select("_id", "_h", F.expr("shiftleft(cast(s as bigint), 32) | e").alias("at"))
    out = with_places(rows, found, "left").mapInArrow(run, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256")
