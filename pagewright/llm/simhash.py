"""SimHash fingerprints, the pairs within a Hamming radius by covering hashes, and their components.

Covering locality-sensitive hashing (Pagh, 2016): bit i gets a vector phi(i) of r + 1 bits, not zero;
table v keeps the bits with an odd product phi(i) * v. For any r differing bits there is a v that drops
all of them, so every pair within the radius meets in one of the 2^(r+1) - 1 tables: no pair is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minhash
from ._shared import bounded_batches, complete_groups, connected_components, doc_id, files_for, keyed, row_key, written

#: A bucket of more fingerprints than this goes on to finer tables.
BUCKET = 8192
#: Finer levels before what is left is compared block by block.
LEVELS = 3


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of width words, repeats included; A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    columns = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, j], minlength=256) @ byte_bits for j in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """_id, _h and fp (64 bits as a signed long) of every row; no word: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((majority(h) if len(h := shingle_hashes(t, width)) else 0 for t in b["_t"].to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["_id"], b["_h"], pa.array(fps.view(np.int64))], names=["_id", "_h", "fp"])

    bounded_batches(docs.sparkSession)
    return keyed(docs).mapInArrow(run, "_id long, _h long, fp long")


def cover(radius: int, turn: int = 0) -> list[int]:
    """The masks of 2^(radius+1) - 1 tables; each turn deals the vectors to the bits anew."""
    n = 2 ** (radius + 1) - 1
    phi = [(i * (1, 7, 11, 13)[turn % 4] + turn * (i // n)) % n + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _spanning(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected within the radius: each member is reached once."""
    left, out = np.arange(len(x)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(x[left] ^ x[i]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                out += [(int(i), int(j)) for j in found]
                queue += found.tolist()
    return out


def _bucket_links(k: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets; k is sorted. Small buckets compare neighbours at each distance."""
    a, b = [], []
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[start, len(k)])
    for s, n in zip(start[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        if pairs := _spanning(x[s : s + n], radius):
            i, j = np.array(pairs).T
            a.append(x[s + i])
            b.append(x[s + j])
    small = np.repeat(size <= 16, size)
    k, x = k[small], x[small]
    for d in range(1, 16):
        at = np.flatnonzero(k[d:] == k[:-d])
        if not len(at):
            break
        at = at[np.bitwise_count(x[at] ^ x[at + d]) <= radius]
        a.append(x[at])
        b.append(x[at + d])
    none = np.empty(0, np.uint64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def covering_links(prints: DataFrame, size: int, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """a, b: links that connect all distinct prints (column fp, about `size` rows) within the radius of each other.

    A table's buckets are streamed in key order. In a bucket each print is linked to the first that
    reaches it, so copies of a kind give a tree and not all their pairs. A bucket of more than `bucket`
    prints moves to the next level: covering tables anew inside it. After LEVELS the prints of a bucket can
    differ in 13 bits at most, so BUCKET prints always suffice; for a smaller `bucket` what still is larger
    is dealt out in blocks, each pair of blocks a task of its own. Nothing is dropped on the way.
    """
    schema = "k long, a long, b long"

    def run(batches: Iterator[pa.RecordBatch], limit: int = bucket) -> Iterator[pa.RecordBatch]:
        for t, over in complete_groups(batches, "k", limit):
            k, x = t["k"].to_numpy(), t["fp"].to_numpy()
            if over:
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(x), pa.nulls(len(x), pa.int64())], names=["k", "a", "b"])
                continue
            a, b = _bucket_links(k, x.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["k", "a", "b"])

    def table(rows: DataFrame, turn: int) -> DataFrame:
        masks = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(_signed(m)).alias("m")) for v, m in enumerate(cover(radius, turn))))
        spread = rows.withColumn("t", F.explode(masks))
        return spread.select(F.xxhash64(*(["k"] if "k" in rows.columns else []), "t.v", F.col("fp").bitwiseAND(F.col("t.m"))).alias("k"), "fp")

    def blocks(rows: DataFrame) -> DataFrame:
        n = rows.groupBy("k").agg(F.ceil(F.count("*") * 2 / bucket).cast("int").alias("n"))
        c = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("n")).cast("int")
        dealt = rows.join(n, "k").withColumn("c", c).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        return dealt.select(F.xxhash64("k", F.least("c", "o"), F.greatest("c", "o")).alias("k"), "fp")

    found, rows = [], prints.select("fp").where("fp is not null").distinct()
    for turn in range(LEVELS + 1):
        last = turn == LEVELS
        keys = blocks(rows) if last else table(rows, turn)
        out = written(keys.repartition("k").sortWithinPartitions("k").mapInArrow((lambda bs: run(bs, 2**62)) if last else run, schema), 8 * size)
        found.append(out.where("k is null").select("a", "b"))
        rows = out.where("k is not null").select("k", F.col("a").alias("fp"))
        if last or rows.isEmpty():
            break
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def near_components(docs: DataFrame, width: int = 3, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """_id, _h, fp and component_id of every row of docs (columns doc_id, text).

    Prints within the radius are linked; component_id is the smallest doc_id that is reachable by links,
    itself included. Equal prints are one node (its smallest doc_id stands for it), so a large group of
    copies costs one row in the search. Null text counts as empty, and texts without words have the
    print zero, which links like any other. Null doc_id sorts first. Repeated rows share one node. An
    empty table gives an empty result.
    """
    size = docs.select("doc_id").count()
    rows = written(fingerprints(docs, width).repartition(files_for(size)))
    nodes = rows.groupBy("fp").agg(F.min("_id").alias("rep"))
    parts = connected_components(covering_links(nodes, size, radius, bucket), nodes=size)
    # the component's own name is a print; its smallest doc_id becomes component_id
    member = nodes.join(parts, nodes["fp"] == parts["node"], "left").select(nodes["fp"], "rep", F.coalesce("component", nodes["fp"]).alias("c"))
    best = member.groupBy("c").agg(F.min("rep").alias("component_id"))
    lookup = written(member.join(best, "c").select("fp", "component_id"), size)
    return rows.join(lookup, "fp").select("_id", "_h", "fp", "component_id")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    out = near_components(docs)
    return out.select(doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), doc_id("component_id").alias("component_id"))


def near_classes(docs: DataFrame, width: int = 5, radius: int = 3, threshold: float = 0.8, **options) -> DataFrame:
    """c, _id, _h and part of every class of texts with one set of runs of width words (minhash.near_classes).

    covering_links proposes the classes whose prints lie within the radius, beside the bands of MinHash: near
    the threshold most prints differ in more bits than covering masks can drop (see the README).
    """
    return minhash.near_classes(docs, lambda text: shingle_hashes(text, width), threshold, mark=majority, proposed=lambda prints, size: covering_links(prints, size, radius), **options)[0]


def keep_one(docs: DataFrame, width: int = 5, radius: int = 3, threshold: float = 0.8, **options: int) -> DataFrame:
    """docs without all but one row of each group of near copies: the row with the smallest doc_id stays.

    Near copies share threshold of their sets of runs of width words (near_classes). Texts without words,
    null included, are one group. Each group keeps one row, whatever ids its rows have: different texts with
    null or equal doc_ids stay apart (by 64-bit hashes). Of equal doc_ids in a group the text with the
    smallest hash stays, of repeated rows the one with the smallest hash of all its columns. Very long texts
    are compared whole; other columns, whatever their names, are unchanged; no rows, no result.
    """
    kept = near_classes(docs, width, radius, threshold, **options).groupBy("part").agg(F.min(F.struct("_id", "_h")).alias("x")).select("x._id", "x._h")
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_key(docs))
    one = tagged.groupBy("_id", "_h").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.join(kept, ["_id", "_h"]).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
