"""Content-defined samples of sequences, and the places whose sample occurs more than once.

Of each stretch of w neighbouring q-grams the one with the smallest hash is sampled. Two equal stretches
sample the same place, so a repeat can be found through samples alone, a small share of all places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, complete_groups, mix, release

#: Samples that a task holds before it combines them and sends them on.
FLUSH = 2_000_000
SLICE = 100_000
#: A sample at more places than this is hot.
HOT = 64


def ngram_hashes(h: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of n elements with the hashes h."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m, out = np.uint64(factor), h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= m
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive integers in sorted codes."""
    if not len(codes):
        return codes, codes
    cut = np.flatnonzero(np.diff(codes) != 1)
    return codes[np.r_[0, cut + 1]], codes[np.r_[cut, len(codes) - 1]]


def sliced(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    names, arrays = list(columns), list(columns.values())
    for i in range(0, len(arrays[0]), SLICE):
        yield pa.RecordBatch.from_arrays([a[i : i + SLICE] for a in arrays], names=names)


class Held:
    """Documents that a task has seen since the last flush, and arrays about places in them."""

    def __init__(self, width: int) -> None:
        self.ids: list[int] = []
        self.hashes: list[int] = []
        self.parts: tuple[list[np.ndarray], ...] = tuple([] for _ in range(width))
        self.size = 0

    def add(self, doc: int, text_hash: int, *arrays: np.ndarray) -> None:
        for part, a in zip(self.parts, (np.full(len(arrays[0]), len(self.ids)), *arrays), strict=True):
            part.append(a)
        self.ids.append(doc)
        self.hashes.append(text_hash)
        self.size += len(arrays[0])

    def drain(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        out = np.array(self.ids, np.int64), np.array(self.hashes, np.int64), [np.concatenate(p) for p in self.parts]
        self.__init__(len(self.parts))
        return out


def repeated_places(docs: DataFrame, sample: Callable[[bytes], tuple[np.ndarray, np.ndarray]], hot: int = HOT, flush: int = FLUSH) -> DataFrame:
    """_id, _h and at: places whose sampled hash occurs at two places or more, as 2 * place + is_hot.

    docs comes from keyed(); sample gives hashes and places of a text's bytes. A hash with over `hot`
    places is hot. A task combines its own samples first: of a hash that it holds more often than that,
    one row with the count goes to the shuffle by hash, and the places, known to be hot, are dealt out by
    themselves. So no hash sends more than `hot` rows from a task, however many documents share it.
    """

    def combined(held: Held) -> Iterator[pa.RecordBatch]:
        ids, hashes, (no, h, at) = held.drain()
        order = np.argsort(h, kind="stable")
        no, h, at = no[order], h[order], at[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        many = np.repeat(size > hot, size)
        k = np.where(many, mix(ids[no].view(np.uint64) ^ at.astype(np.uint64)), h)
        count = size[size > hot]
        zero = np.zeros(len(count), np.int64)
        yield from sliced({
            "k": pa.array(np.r_[k, h[start[size > hot]]].view(np.int64)), "n": pa.array(np.r_[np.where(many, 0, 1), count].astype(np.int32)),
            "_id": pa.array(np.r_[ids[no], zero]), "_h": pa.array(np.r_[hashes[no], zero]), "at": pa.array(np.r_[at, zero - 1].astype(np.int32)),
        })

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = Held(3)
        for b in batches:
            for doc, text_hash, text in zip(b["_id"].to_pylist(), b["_h"].to_pylist(), b["_t"].cast(pa.binary()).to_pylist(), strict=True):
                h, at = sample(text)
                if len(h):
                    held.add(doc, text_hash, h, at)
                if held.size >= flush:
                    yield from combined(held)
        if held.size:
            yield from combined(held)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, over in complete_groups(batches, "k", 2 * hot, 100_000):
            k, n, at = (t[c].to_numpy() for c in ("k", "n", "at"))
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            total = np.repeat(np.add.reduceat(n, start, dtype=np.int64), np.diff(np.r_[start, len(k)]))
            if over:  # a piece of a hash with more places than are held
                total[:] = 2 * hot
            keep = (at >= 0) & ((n == 0) | (total > 1))
            at = 2 * at[keep] + ((n == 0) | (total > hot))[keep]
            out = t.select(["_id", "_h"]).filter(pa.array(keep)).append_column("at", pa.array(at.astype(np.int32)))
            yield from out.combine_chunks().to_batches()

    bounded_batches(docs.sparkSession)
    rows = docs.mapInArrow(first, "k long, n int, _id long, _h long, at int")
    return rows.repartition("k").sortWithinPartitions("k").mapInArrow(second, "_id long, _h long, at int")


def owners_of(owners: np.ndarray, n: int, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The windows whose owner is a hot place, and those whose owner is another repeated place."""
    flag = np.zeros(n + 1, np.int8)
    places = np.array(at, np.int64)
    flag[places >> 1] = 1 + (places & 1)
    kind = flag[owners]
    return np.flatnonzero(kind == 2), np.flatnonzero(kind == 1)


def stretches(owners: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in s of the stretches of windows with one owner."""
    cut = np.flatnonzero(np.diff(owners[s])) + 1
    return np.r_[0, cut][: len(s)], np.r_[cut, len(s)][: max(len(s), 0) and len(cut) + 1]


def with_places(docs: DataFrame, places: DataFrame, how: str, column: str = "at") -> DataFrame:
    """docs, dealt out by document, with the list of each document's values of column."""
    lists = places.groupBy("_id", "_h").agg(F.collect_list(column).alias(column))
    return docs.repartition("_id", "_h").join(lists, ["_id", "_h"], how)
