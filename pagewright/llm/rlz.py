"""Substring dedup of words by relative Lempel-Ziv parsing against the corpus's own earlier text.

The reference is all text that comes earlier (smaller doc_id, or further left in the document). It is cut
into blocks by content: a block is the phrases (runs of `window` words) around one sampled 6-gram, with an
index of the first place of each phrase. Two equal phrases always share the 6-gram that owns them (see
_samples), so each stretch of a document need be parsed against its own blocks only, and none but blocks
that a sample says two places share are built. A stretch is parsed greedily from left to right: a factor
starts at a phrase that the index has, and grows phrase by phrase as long as its source goes on alike. Where
it ends, the next phrases straddle its boundary; they are looked up in turn, so a repeat that starts inside
a factor and runs past its end is found. Factors have `window` words or more and become duplicate spans.

Phrases of a sample at few places travel as one row by the sample's hash. Those of a hot sample travel each
by their own hash, after the task has parsed its own copies: there a factor that other tasks' text gives is
one phrase, and neighbouring factors of a document are joined when its spans are. Phrases are compared by
64-bit hashes and, if of a hot sample, 32 bits more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ._samples import FLUSH, HOT, Held, ngram_hashes, owners_of, repeated_places, sliced, stretches, with_places
from ._shared import apart, bounded_batches, complete_groups, doc_id, keyed, mix, row_key, window_owners

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def word_hashes(text: bytes) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, text.split()), np.uint64)


def parsed(first: np.ndarray, later: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where greedy factors start, and the number of phrases of each.

    first: the first place of each phrase, by place; later: whether that is another one; stretch: the
    stretch of each place. All stretches are parsed at once, from left to right.
    """
    size, grows, step = np.ones(len(first), np.int64), np.flatnonzero(later), 1
    while len(grows):
        grows = grows[grows + step < len(first)]
        source = first[grows]
        x, y = grows + step, source + step
        grows = grows[(stretch[x] == stretch[grows]) & (stretch[y] == stretch[source]) & (first[x] == first[y])]
        size[grows] += 1
        step += 1
    at, starts = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]][: len(stretch)]), []
    while len(at):
        starts.append(at[later[at]])
        after = at + np.where(later[at], size[at], 1)
        inside = after < len(first)
        at, after = at[inside], after[inside]
        at = after[stretch[after] == stretch[at]]
    starts = np.sort(np.concatenate(starts)) if starts else np.empty(0, np.int64)
    return starts, size[starts]


def factors(docs: DataFrame, window: int = 20, gram: int = 6, hot: int = HOT, flush: int = FLUSH) -> DataFrame:
    """_id, _h, s, e, src, src_s: the words s to e (exclusive) of a document repeat those at src_s of src.

    docs comes from keyed(). Factors of a document may overlap; all have window words or more, and their
    source starts earlier. Memory: a task holds `flush` phrases at most, and a document's factors.
    """
    gram = min(gram, window)
    span = window - gram + 1

    def sample(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        g = ngram_hashes(word_hashes(text), gram)
        owners = window_owners(g, span)
        at = owners[np.r_[True, owners[1:] != owners[:-1]]] if len(owners) else owners
        return g[at], at

    def looked_up(held: Held) -> Iterator[pa.RecordBatch]:
        """A phrase's first place in this task goes to its block; a later one is a factor already."""
        ids, hashes, (no, w, v, s) = held.drain()
        rank = np.empty(len(ids), np.int64)
        by_doc = np.lexsort((hashes, ids))
        rank[by_doc] = np.arange(len(ids))
        code = rank[no] << 32 | s
        order = np.lexsort((code, w))
        w, v, code = w[order], v[order], code[order]
        start = np.r_[True, (w[1:] != w[:-1]) | (v[1:] != v[:-1])]
        first = code[np.maximum.accumulate(np.where(start, np.arange(len(w)), 0))]
        later = ~start & (code != first)
        one, doc = code[start], by_doc
        yield from sliced(_rows(w[start], v[start], ids[doc[one >> 32]], hashes[doc[one >> 32]], one & 0xFFFFFFFF))
        code, first = code[later], first[later]
        order = np.argsort(code, kind="stable")
        code, first = code[order], first[order]
        if len(code):
            cut = np.flatnonzero((np.diff(code) != 1) | (np.diff(first) != 1))
            a, b = np.r_[0, cut + 1], np.r_[cut, len(code) - 1]
            d, f = doc[code[a] >> 32], first[a]
            yield from sliced(_rows(mix(code[a].view(np.uint64)), np.zeros(len(a), np.int32), ids[d], hashes[d], code[a] & 0xFFFFFFFF, (code[b] & 0xFFFFFFFF) + window, ids[doc[f >> 32]], f & 0xFFFFFFFF))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = Held(4), set()
        for b in batches:
            rows: list[tuple[int, int, int, int, bytes]] = []
            for doc, text_hash, text, at in zip(b["_id"].to_pylist(), b["_h"].to_pylist(), b["_t"].cast(pa.binary()).to_pylist(), b["at"].to_pylist(), strict=True):
                if (doc, text_hash) in seen:
                    continue
                seen.add((doc, text_hash))
                h = word_hashes(text)
                g, w = ngram_hashes(h, gram), ngram_hashes(h, window)
                owners = window_owners(g, span)
                s, few = owners_of(owners, len(h), at)
                if len(s):
                    v = (ngram_hashes(h, window, 0xD6E8FEB86659FD93)[s] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    held.add(doc, text_hash, w[s], v, s)
                if len(few):
                    a, z = stretches(owners, few)
                    data, k = w[few].tobytes(), g[owners[few[a]]].view(np.int64).tolist()
                    rows += [(key, doc, text_hash, s0, data[8 * i : 8 * j]) for key, s0, i, j in zip(k, few[a].tolist(), a.tolist(), z.tolist(), strict=True)]
                if held.size >= flush:
                    yield from looked_up(held)
            if rows:
                k, ids, hashes, s, data = zip(*rows, strict=True)
                zero = np.zeros(len(k), np.int64)
                yield from sliced(_rows(np.array(k, np.int64), zero.astype(np.int32), np.array(ids, np.int64), np.array(hashes, np.int64), np.array(s, np.int64), ws=data))
        if held.size:
            yield from looked_up(held)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of a block are parsed against the block's index; factors pass through."""
        names = ["_id", "_h", "s", "e", "src", "src_s"]
        for t, _ in complete_groups(batches, "k", 2**62, 20_000):
            k, v, s, e, i, h = (t[c].to_numpy() for c in ("k", "v", "s", "e", "_id", "_h"))
            lists = t["ws"].is_valid().to_numpy()
            yield from t.select(names).filter(pa.array(e > 0)).combine_chunks().to_batches()
            one = (e == 0) & ~lists
            data = t["ws"].filter(pa.array(lists)).to_pylist()
            size = np.fromiter(map(len, data), np.int64, len(data)) // 8
            row = np.repeat(np.arange(len(size)), size)
            step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            w = np.frombuffer(b"".join(data), np.uint64)
            # a phrase in a list is known by its hash and by the sample's
            w = mix(w ^ mix(k[lists].view(np.uint64))[row])
            alone = np.arange(np.count_nonzero(one))
            for key, check, stretch, i_, h_, s_ in ((k[one].view(np.uint64), v[one], alone, i[one], h[one], s[one]), (w, np.zeros(len(w), np.int32), row, i[lists][row], h[lists][row], s[lists][row] + step)):
                order = np.argsort(key, kind="stable")  # rows come by document, so the first of equals is the earliest
                key, check = key[order], check[order]
                start = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])][: len(key)]
                first = np.empty(len(key), np.int64)
                first[order] = order[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
                later = (i_ != i_[first]) | (h_ != h_[first]) | (s_ != s_[first])
                at, n = parsed(first, later, stretch)
                f = first[at]
                out = i_[at], h_[at], s_[at].astype(np.int32), (s_[at] + n - 1 + window).astype(np.int32), i_[f], s_[f].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    bounded_batches(docs.sparkSession)
    schema = "k long, v int, _id long, _h long, s int, e int, src long, src_s int, ws binary"
    found = with_places(docs, repeated_places(docs, sample, hot, flush), "inner").mapInArrow(phrases, schema)
    found = found.repartition("k").sortWithinPartitions("k", "v", "_id", "_h", "s")
    return found.mapInArrow(blocks, "_id long, _h long, s int, e int, src long, src_s int")


def _rows(k, v, ids, hashes, s, e=None, src=None, src_s=None, ws=None) -> dict[str, pa.Array]:
    zero = np.zeros(len(k), np.int64)
    as_int = lambda x: pa.array((zero if x is None else x).astype(np.int32))
    return {"k": pa.array(k.view(np.int64)), "v": pa.array(v), "_id": pa.array(ids), "_h": pa.array(hashes), "s": as_int(s), "e": as_int(e), "src": pa.array(zero if src is None else src), "src_s": as_int(src_s), "ws": pa.nulls(len(k), pa.binary()) if ws is None else pa.array(ws, pa.binary())}


def removed(n: int, spans: list[int] | None) -> np.ndarray:
    """Which of n places the spans (start << 32 | end) cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        x = np.array(spans, np.int64)
        np.add.at(edge, x >> 32, 1)
        np.add.at(edge, x & 0xFFFFFFFF, -1)
    return np.cumsum(edge[:n]) > 0


def _with_spans(docs: DataFrame, window: int, **options: int) -> DataFrame:
    found = factors(docs, window, **options).select("_id", "_h", F.expr("shiftleft(cast(s as bigint), 32) | e").alias("at"))
    return with_places(docs, found, "left")


def query(docs: DataFrame, window: int = 20, **options: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (columns doc_id, text).

    A word goes if a window of `window` words over it also starts earlier: at a smaller doc_id, or further
    left in its document. Windows are judged on the input. Null text has no words. Rows without a doc_id
    are documents of their own and come before all others, in one order or another. Repeated rows (equal
    doc_id and text) are one document and get one result each; of different texts with one doc_id the one
    with the smaller 64-bit hash comes first. Texts of fewer words than the window keep all; very long ones
    are read whole; no rows, no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b["_t"].cast(pa.binary()).to_pylist(), b["at"].to_pylist(), strict=True):
                words = text.split()
                kept = words
                if spans:
                    kept = [w for w, gone in zip(words, removed(len(words), spans).tolist(), strict=True) if not gone]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["_id", "n_words", "n_removed", "kept_sha256"])

    out = _with_spans(apart(keyed(docs)), window, **options).mapInArrow(run, "_id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(doc_id(), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = 20, **options: int) -> DataFrame:
    """docs with the repeated words cut from text, and n_chars (if there) counted anew.

    White space stays before a word that stays. A row all of whose words go is dropped; a row without
    words, null text included, stays as it is. Ids, repeated rows and ties are as in query. Other columns,
    whatever their names, are unchanged; they travel with the text, which is dealt out once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new: list[str | None] = []
            changed, keep = [], []
            for text, whole, spans in zip(b["_t"].cast(pa.binary()).to_pylist(), b["_there"].to_pylist(), b["at"].to_pylist(), strict=True):
                at = [m.span() for m in WORDS.finditer(text)] if spans else []
                gone = removed(len(at), spans)
                if gone.any():
                    ends = [0, *(e for _, e in at)]
                    kept = b"".join(text[ends[i] : ends[i + 1]] for i in np.flatnonzero(~gone).tolist()).strip()
                    new.append(kept.decode("utf-8", "replace"))
                else:
                    new.append(text.decode("utf-8", "replace") if whole else None)
                changed.append(bool(gone.any()))
                keep.append(not gone.any() or not gone.all())
            out = pa.RecordBatch.from_arrays([b["_row"], pa.array(new, pa.string()), pa.array(changed, pa.bool_())], names=["_row", "_new", "_changed"])
            yield out.filter(pa.array(keep, pa.bool_()))

    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row")
    rows = docs.select(*row_key(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"), F.col("text").isNotNull().alias("_there"), others)
    schema = StructType([rows.schema["_row"], StructField("_new", StringType()), StructField("_changed", BooleanType())])
    out = _with_spans(apart(rows), window, **options).mapInArrow(run, schema)

    def column(c: str):
        if c == "text":
            return F.col("_new").alias(c)
        if c == "n_chars":
            return F.when(F.col("_changed"), F.length("_new")).otherwise(F.col("_row.n_chars")).cast(dict(docs.dtypes)[c]).alias(c)
        return F.col(f"_row.`{c}`").alias(c)

    return out.select(*map(column, docs.columns))
