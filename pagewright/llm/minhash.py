"""MinHash fingerprints of documents, and near duplicates by their bands.

A text's shingles are runs of five words. K universal hash functions (multiply and add) permute the
shingle hashes; a signature keeps 16 bits of each function's minimum. The share of equal places in two
signatures estimates the Jaccard similarity of the shingle sets. Texts whose signatures agree in a band are
candidates: links of candidates make groups, and the pairs of a group are verified on whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._samples import ngram_hashes
from ._shared import bounded_batches, complete_groups, connected_components, doc_id, keyed, mix, release, written

PERMUTATIONS = 128
WIDTH = 5
#: Rows of text that a range of doc_ids holds about, when documents are put in order.
RANGE_ROWS = 4000
#: Beyond so many ranges they get larger instead; their cuts are a list of longs that travels with the code.
MOST_RANGES = 100_000
#: Pairs are verified whose signatures are alike by the threshold less this: over four standard errors.
GATE = 0.15
#: Rows of a few numbers that a row with a signature counts as.
SIGNATURE_ROWS = 10
#: Classes that are linked, or whose groups are verified, in one go.
LINKED_TOGETHER, VERIFIED_TOGETHER = 20_000, 500
#: Classes and shingles of about one part of a large bucket; two parts meet in a task.
PART_ROWS, PART_SHINGLES = 2048, 1 << 19


def shingles(text: str, width: int = WIDTH, edges: bool = True) -> np.ndarray:
    """64-bit hashes of the runs of `width` words between ASCII white space.

    edges: the text's borders count as width - 1 blank words, so that short texts have shingles that a
    change at the other end leaves alone. Without them a text of fewer words is one shingle.
    """
    from xxhash import xxh64_intdigest

    h = np.fromiter(map(xxh64_intdigest, text.encode("utf-8", "replace").split()), np.uint64)
    if not len(h):
        return h
    if edges:
        blank = np.zeros(width - 1, np.uint64)
        h = np.concatenate([blank, h, blank])
    return ngram_hashes(h, min(width, len(h)))


def signature(h: np.ndarray, permutations: int = PERMUTATIONS, block: int = 1024) -> np.ndarray:
    """16 bits of the minimum of each permutation; without shingles all ones."""
    if not len(h):
        return np.full(permutations, 0xFFFF, np.uint16)
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = (seeds[:permutations] | np.uint64(1))[:, None], seeds[permutations:, None]
    low = np.full(permutations, 2**64 - 1, np.uint64)
    for i in range(0, len(h), block):
        np.minimum(low, (h[None, i : i + block] * a + b).min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first code points of following."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def sortable(*numbers: np.ndarray) -> np.ndarray:
    """Fixed-width strings that sort like the pairs of signed 64-bit numbers."""
    flipped = np.stack([x.astype(np.int64).view(np.uint64) ^ np.uint64(2**63) for x in numbers], axis=1).astype(">u8")
    # a byte that isn't zero comes last, as strings end before zeros
    return np.concatenate([np.ascontiguousarray(flipped).view(np.uint8).reshape(len(flipped), 16), np.ones((len(flipped), 1), np.uint8)], axis=1).view("S17")[:, 0]


def query(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document of a row is the one with the next smaller doc_id; after the smallest comes the
    largest. Equal doc_ids follow each other by falling 64-bit hash of their text; a null doc_id is the
    smallest. Null text counts as empty, its fingerprint is all ones; very long texts are read whole.
    Repeated rows are one document and get one result each. A single row is its own next. No rows, no result.

    Rows are dealt out by ranges of doc_id and hash, each cut at a pair that occurs; the row at a cut also
    goes to the range above it as the next document of its last row. So texts are shuffled once, no window
    spans the table, and rows of one doc_id, or of none, fill many ranges. Twenty pairs a range, picked by
    hash, reach the driver to choose the cuts.
    """
    rows = keyed(docs)
    seen = rows.agg(F.count("*").alias("n"), F.max(F.struct("_id", "_h")).alias("high")).first()
    parts = min(MOST_RANGES, max(1, -(-seen.n // range_rows)))
    ids = rows.select("_id", "_h")
    if seen.n > 20 * parts:
        ids = ids.where(F.pmod(F.xxhash64("_id", "_h", F.lit(9)), F.lit(seen.n)) < 20 * parts)
    picked = sorted(tuple(r) for r in ids.distinct().collect())
    step = 20 if seen.n > 20 * parts else range_rows
    cuts = sorted({*picked[step - 1 :: step], *([tuple(seen.high)] if seen.n else [])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range and falling doc_id; the range's last is the next document of its last row."""
        held: tuple | None = None
        cost = ("_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        for b in batches:
            out = []
            for place, lent, doc, name, text in zip(*(b[c].to_pylist() for c in ("_range", "_lent", "_id", "_h", "_t")), strict=True):
                if held and held[0] == place and held[1] is None:
                    continue  # more rows like that at the cut
                if held and not lent and held[:3] == (place, doc, name):  # a repeated row
                    held = (*held[:5], held[5] + 1)
                    continue
                sig = signature(shingles(text, width), permutations)
                if held and held[0] == place:
                    _, before, _, t, s, times = held
                    new = edited(t, text)
                    e = s if new == t else signature(shingles(new, width), permutations)
                    out += times * [(before, len(t), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), s.astype(">u2").tobytes().hex(), e.astype(">u2").tobytes().hex(), likeness(s, e), likeness(s, sig))]
                held = (place, None if lent else doc, name, text, sig, 1)
            columns = list(zip(*out, strict=True)) or [()] * len(cost)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(cost))

    bounded_batches(docs.sparkSession)
    n = len(cuts)
    whole = sortable(*np.array(cuts, np.int64).reshape(-1, 2).T)

    @F.pandas_udf("int")
    def placed(doc: pd.Series, name: pd.Series) -> pd.Series:
        mine = sortable(doc.to_numpy(), name.to_numpy())
        at = np.searchsorted(whole, mine)
        return pd.Series((2 * at + (whole[at] == mine)).astype(np.int32))

    row = [F.col(c) for c in ("_id", "_h", "_t")]
    at = rows.withColumn("_place", placed("_id", "_h")).select(*row, F.shiftright("_place", 1).alias("_range"), (F.col("_place") % 2 == 1).alias("_top"))
    top = F.col("_top")
    both = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("l")), F.struct(((F.col("_range") + 1) % max(1, n)).cast("int").alias("r"), F.lit(True).alias("l")))
    one = F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("l")))
    spread = at.select(*row, F.explode(F.when(top, both).otherwise(one)).alias("x")).select(F.col("x.r").alias("_range"), F.col("x.l").alias("_lent"), *row)
    order = spread.repartition("_range").sortWithinPartitions("_range", "_lent", F.desc("_id"), F.desc("_h"))
    out = order.mapInArrow(run, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(doc_id(), *out.columns[1:])


def band_keys(bands: int) -> Column:
    """The buckets of a signature (column sig), one for each band."""
    size = F.floor(F.length("sig") / (2 * bands)).cast("int") * 2
    return F.array(*(F.xxhash64(F.lit(i), F.col("sig").substr(size * i + 1, size)) for i in range(bands)))


def joined_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that pairs of places connect each of n places with."""
    low = np.arange(n)
    while True:
        before, least = low.copy(), np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if (low == before).all():
            return low


def band_links(classes: DataFrame, threshold: float = 0.8, bands: int = 25, most: int = 64) -> DataFrame:
    """a, b: links that connect all candidates among classes (columns c, sig) that agree in a band.

    In a bucket of up to `most` classes those are candidates whose signatures are alike by threshold - GATE;
    in a larger one all are. What candidates connect in a bucket is linked to its first class, so each class
    gets one link a bucket at most, and a large bucket is streamed.
    """
    least = threshold - GATE

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = None
        for t, over in complete_groups(batches, "k", most, LINKED_TOGETHER):
            k, c = t["k"].to_numpy(), t["c"].to_numpy()
            if over:
                if center is None or center[0] != k[0]:
                    center = k[0], c[0]
                c = c[c != center[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), center[1])), pa.array(c)], names=["a", "b"])
                continue
            same = k[1:] == k[:-1]
            met = np.r_[False, same] | np.r_[same, False]
            k, c, t = k[met], c[met], t.filter(pa.array(met))
            if not len(k):
                continue
            sig, alike = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(len(k), -1), []
            for d in range(1, most):
                at = np.flatnonzero(k[d:] == k[:-d])
                if not len(at):
                    break
                at = at[np.count_nonzero(sig[at] == sig[at + d], axis=1) >= least * sig.shape[1]]
                alike.append((at, at + d))
            low = joined_pairs(len(k), *map(np.concatenate, zip(*alike, strict=True)))
            at = np.flatnonzero(low != np.arange(len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(c[low[at]]), pa.array(c[at])], names=["a", "b"])

    # signatures follow only to buckets of two or more
    spread = classes.select(F.explode(band_keys(bands)).alias("k"), "c")
    shared = spread.join(spread.groupBy("k").count().where("count > 1").select("k"), "k", "left_semi")
    both = shared.join(classes.select("c", "sig"), "c").select("k", "c", "sig")
    return both.repartition("k").sortWithinPartitions("k", "c").mapInArrow(meet, "a long, b long").distinct()


def _open_pairs(sig: np.ndarray, label: np.ndarray, p: np.ndarray, band: int, bands: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each place with the later ones alike by least that have another label by then.

    Pairs that meet in an earlier band are left to it; number `bands` is no band and leaves none. p: the
    part of each place; with two parts only the pairs across them count, as those inside a part have a group
    of their own.
    """
    size, across = sig.shape[1] // bands, (p != p[0]).any()
    band %= bands
    for i in range(len(sig) - 1):
        at = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & ((p[i + 1 :] != p[i]) | (not across)))
        if not len(at):
            continue
        same = sig[at] == sig[i]
        near = np.count_nonzero(same, axis=1) >= least * sig.shape[1]
        near &= ~same[:, : band * size].reshape(len(at), band, size).all(axis=2).any(axis=1)
        if near.any():
            yield i, at[near]


def _by_group(t: pa.Table) -> Iterator[tuple[pa.Table, tuple]]:
    """The groups of a table sorted by g, and what _open_pairs takes of each."""
    g = t["g"].to_numpy()
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    for s, n in zip(start.tolist(), np.diff(np.r_[start, len(g)]).tolist(), strict=True):
        x = t.slice(s, n)
        sig = np.frombuffer(b"".join(x["sig"].to_pylist()), np.uint16).reshape(n, -1)
        yield x, (sig, np.arange(n), x["p"].to_numpy(), x["i"][0].as_py())


def verified_links(groups: DataFrame, read: Callable[[str], np.ndarray], threshold: float, bands: int) -> DataFrame:
    """a, b: links that connect all classes of a group by pairs of Jaccard similarity threshold or more.

    groups: g, i, p, c, sig and the class's text x, of which read makes the sorted set. Every pair of a
    group that is alike by threshold - GATE is verified on its sets, or joined by verified links already.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in complete_groups(batches, "g", 2**62, VERIFIED_TOGETHER):
            g, c = t["g"].to_numpy(), t["c"].to_numpy()
            t = t.filter(pa.array(np.r_[True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])]))  # repeated rows
            a, b = [], []
            for x, (sig, label, p, band) in _by_group(t):
                found = [read(text) for text in x["x"].to_pylist()]
                c, size = x["c"].to_numpy(), np.array([len(h) for h in found])
                start = np.r_[0, np.cumsum(size)]
                names, place = np.unique(np.concatenate(found), return_inverse=True)
                mine = np.zeros(len(names), bool)
                for i, at in _open_pairs(sig, label, p, band, bands, threshold - GATE):
                    own = place[start[i] : start[i + 1]]
                    mine[own] = True
                    first = start[at[0]]
                    upto = np.r_[0, np.cumsum(mine[place[first : start[at[-1] + 1]]])]
                    mine[own] = False
                    both = upto[start[at + 1] - first] - upto[start[at] - first]
                    at = at[both >= threshold * (size[i] + size[at] - both)]
                    if len(at):
                        a += [c[i]] * len(at)
                        b += c[at].tolist()
                        label[np.isin(label, label[at])] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.repartition("g").sortWithinPartitions("g", "c").mapInArrow(check, "a long, b long")


def dealt_links(classes: DataFrame, sets: DataFrame, read: Callable[[str], np.ndarray], threshold: float, bands: int, further: DataFrame, rows: int = PART_ROWS, shingles: int = PART_SHINGLES) -> DataFrame:
    """verified_links of classes (c, sig, w) that share a band or a bucket of further (k, c), however many do.

    Each bucket is dealt out in parts of about `rows` classes and `shingles`, every two of them a group of
    its own. Signatures tell first which classes of a group have a pair to verify; only their texts follow.
    """

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in complete_groups(batches, "g", 2**62):
            for x, (sig, label, p, band) in _by_group(t):
                met = np.zeros(len(sig), bool)
                for i, at in _open_pairs(sig, label, p, band, bands, threshold - GATE):
                    met[i] = met[at] = True
                yield from x.select(["g", "i", "p", "c"]).filter(pa.array(met)).combine_chunks().to_batches()

    spread = classes.select(F.posexplode(band_keys(bands)).alias("i", "k"), "c").unionByName(further.select(F.lit(bands).alias("i"), "k", "c"))
    members = written(spread.join(classes.select("c", "w"), "c"))
    n = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("w") / shingles)).cast("int").alias("n")
    deal = members.groupBy("i", "k").agg(n, F.count("*").alias("all")).where("all > 1").select("i", "k", "n")
    dealt = members.join(deal, ["i", "k"]).withColumn("p", F.pmod(F.xxhash64("c", F.lit(1)), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(F.xxhash64("i", "k", F.least("p", "o"), F.greatest("p", "o")).alias("g"), "i", "p", "c")
    some = dealt.join(classes.select("c", "sig"), "c").repartition("g").sortWithinPartitions("g", "c").mapInArrow(waiting, "g long, i int, p int, c long")
    return verified_links(some.join(classes.select("c", "sig"), "c").join(sets, "c"), read, threshold, bands)


def near_classes(
    docs: DataFrame,
    hashes: Callable[[str], np.ndarray],
    threshold: float = 0.8,
    bands: int = 25,
    permutations: int = PERMUTATIONS,
    mark: Callable[[np.ndarray], int] | None = None,
    proposed: Callable[[DataFrame, int], DataFrame] | None = None,
    with_rows: bool = False,
    most: int = 64,
    rows: int = PART_ROWS,
    shingles: int = PART_SHINGLES,
) -> tuple[DataFrame, DataFrame]:
    """Classes with their part (c, _id, _h, part), and rows with their class (_id, _h, c; written if with_rows).

    A class is the rows whose texts have one set of hashes; _id and _h are those of its first row. A part is
    what links of Jaccard similarity threshold or more between classes reach. Candidates are the classes
    that agree in a band of their signatures, and what proposed links by the print that mark makes (column
    fp). What candidates connect is one group, each class once; groups of more than `rows` classes or
    `shingles` are dealt out by their buckets (dealt_links). All pairs of a group, or of a bucket, that are
    alike by threshold - GATE are verified on whole texts.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            prints, names, sigs, sizes = [], [], [], []
            for text in b["_t"].to_pylist():
                h = hashes(text)
                prints.append(mark(h) if mark and len(h) else 0)
                h = np.unique(h)
                names.append(int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "little", signed=True))
                sigs.append(signature(h, permutations).tobytes())
                sizes.append(len(h))
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b["_id"], b["_h"], fp, pa.array(names, pa.int64()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["_id", "_h", "fp", "c", "sig", "w"])

    def read(text: str) -> np.ndarray:
        return np.unique(hashes(text))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated rows come one after the other from a sorted join; only the first goes on."""
        last = None
        for b in batches:
            c = b["c"].to_numpy()
            yield b.filter(pa.array(np.r_[c[:1] != last, c[1:] != c[:-1]][: len(c)].astype(bool)))
            last = c[-1] if len(c) else last

    bounded_batches(docs.sparkSession)
    texts = keyed(docs)
    size = docs.select("doc_id").count()
    sketches = texts.mapInArrow(sketch, "_id long, _h long, fp long, c long, sig binary, w long")
    sketches = written(sketches) if with_rows else sketches
    classes = sketches.groupBy("c").agg(F.min(F.struct("_id", "_h", "fp", "sig", "w")).alias("x"))
    classes = written(classes.select("c", *(f"x.{x}" for x in ("_id", "_h", "fp", "sig", "w"))), SIGNATURE_ROWS * size)
    links = band_links(classes.where("w > 0").select("c", "sig"), threshold, bands, most)
    if proposed:
        nodes = classes.groupBy("fp").agg(F.min("c").alias("n"))
        equal = classes.select("c", "fp").join(nodes, "fp").where("c != n").select(F.col("n").alias("a"), F.col("c").alias("b"))
        by_print = proposed(nodes, size).join(nodes.select(F.col("fp").alias("a"), F.col("n").alias("na")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("n").alias("nb")), "b")
        by_print = equal.unionByName(by_print.select(F.col("na").alias("a"), F.col("nb").alias("b")))
        links = links.unionByName(by_print)
    groups = connected_components(links, nodes=size)
    member = classes.join(groups, F.col("c") == F.col("node")).select("c", "_id", "_h", "sig", "w", F.col("component").alias("g"))
    large = groups.join(classes.select("c", "w"), F.col("c") == F.col("node")).groupBy("component").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    large = written(large.where((F.col("n") > rows) | (F.col("w") > shingles)).select(F.col("component").alias("g")), size // rows)
    sets = lambda some: some.select("c", "_id", "_h").join(texts, ["_id", "_h"]).select("c", F.col("_t").alias("x")).mapInArrow(once, "c long, x string")
    if large.isEmpty():
        small, more = member, None
    else:
        small, dealt = member.join(large, "g", "left_anti"), written(member.join(large, "g", "left_semi"))
        buckets = connected_components(by_print).select(F.col("component").alias("k"), F.col("node").alias("c")) if proposed else dealt.select(F.lit(0).cast("long").alias("k"), "c").limit(0)
        more = dealt_links(dealt.select("c", "sig", "w"), sets(dealt), read, threshold, bands, buckets.join(dealt.select("c"), "c", "left_semi"), rows, shingles)
    one = small.join(texts, ["_id", "_h"]).select("g", F.lit(bands).alias("i"), F.lit(0).alias("p"), "c", "sig", F.col("_t").alias("x"))
    found = verified_links(one.mapInArrow(once, one.schema), read, threshold, bands)
    joined = connected_components(found if more is None else found.unionByName(more), nodes=size)
    parts = classes.join(joined, F.col("c") == F.col("node"), "left").select("c", "_id", "_h", F.coalesce("component", "c").alias("part"))
    return parts, sketches.select("_id", "_h", "c")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, **options) -> DataFrame:
    """doc_id, class_id and group_id of every row of docs (columns doc_id, text).

    class_id is the smallest doc_id whose text has the same set of runs of `width` words, group_id the
    smallest that links of Jaccard similarity threshold or more between such sets reach (near_classes).
    Texts without words, null included, are one class; a null doc_id sorts first and names its group null;
    repeated rows, and different texts with one doc_id, get a row each; very long texts are read whole; no
    rows, no result.
    """
    parts, rows = near_classes(docs, lambda text: shingles(text, width, edges=False), threshold, with_rows=True, **options)
    named = parts.groupBy("part").agg(F.min("_id").alias("group_id"))
    names = parts.join(named, "part").select("c", F.col("_id").alias("class_id"), "group_id")
    out = rows.join(names, "c")
    return out.select(doc_id(), *(doc_id(x).alias(x) for x in ("class_id", "group_id")))
