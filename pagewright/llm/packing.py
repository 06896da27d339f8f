"""Best-fit packing of token pieces into sequences of a fixed length.

Large-item matching: pieces above a third of the capacity go two to a sequence at most, the largest with
the largest that still fits; smaller pieces then go, largest first, to the fullest sequence with room.
Pieces are packed in groups of a fixed number of tokens, so the work of a task is bounded at any size of
the corpus, and a group wastes part of its last sequences only.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Remembered, bounded_batches, coded_words, doc_id, files_for, keyed, process_wide, written

#: Tokens packed in one group.
GROUP = 8_000_000
#: Chunks of text, of about 200 bytes each, that a Python worker remembers in either of two generations.
REMEMBERED = 300_000

# The tokenizer file's parts that chunks rely on, and its bytes' alphabet.
SHAPE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Lower-case words of ASCII and Latin-1 letters (all are their own NFC).
WORD = re.compile("[a-zß-öø-ÿ]+")
#: Such a word and marks without an apostrophe, which would bind to letters: split there by the tokenizer too.
MARKED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")
#: Byte-level alphabet: bytes that don't print stand as 256 and on, in order.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}
#: The small Latin-1 letters as the model sees their UTF-8 bytes.
LETTER_BYTES = {c: chr(c).encode().decode("latin-1").translate(BYTE_CHARS) for c in range(0xDF, 0x100)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    """Ids of texts, chunk by chunk.

    The tokenizer this is made for lower-cases, splits at white space before anything else, and no rule
    looks across it: a text's ids are those of its chunks between ASCII white space. So a batch is split in
    Arrow, its different chunks are looked up once, and ids are gathered by number. A file with another
    normalizer or pre-tokenizer than SHAPE encodes whole texts instead.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        self.by_chunk = all(shape.get(k) == v for k, v in SHAPE.items()) and not any(shape["model"].get(k) for k in ("dropout", "unk_token"))
        self.ids = Remembered(self._learn, remembered)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        found, tokenize, odd, marked = {}, self.tokenizer.model.tokenize, [], []
        packed = lambda ids: array("I", ids).tobytes()
        word = lambda c: packed([t.id for t in tokenize(c if c.isascii() else c.translate(LETTER_BYTES))])
        for c in chunks:
            if c.isascii() and c.isalpha() and c.islower() or WORD.fullmatch(c):  # only the model has something to do
                found[c] = word(c)
            elif m := MARKED.fullmatch(c):
                marked.append(m.groups())
            else:
                odd.append(c)
        odd += {marks for _, marks in marked if marks not in found}
        ids = self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)
        found.update(zip(odd, (packed(e.ids) for e in ids), strict=True))
        found.update((w + marks, (found.get(w) or word(w)) + found[marks]) for w, marks in marked)
        return [found[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin (and the last one's end)."""
        if not self.by_chunk:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.cumsum([0, *map(len, found)])
        names, at, begin = coded_words(plainer(texts))
        parts = self.ids(names)
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        ids = np.frombuffer(b"".join(parts), "<u4")
        n = size[at]
        upto = np.r_[0, np.cumsum(n, dtype=np.int64)]
        shift = (np.cumsum(size, dtype=np.int64) - size)[at] - upto[:-1]
        place = np.repeat(shift.astype(np.int32), n) if upto[-1] < 2**31 else np.repeat(shift, n)
        place += np.arange(upto[-1], dtype=place.dtype)
        out = ids[place]
        return out, upto[begin]


def plainer(texts: pa.Array) -> pa.Array:
    """texts with fewer different chunks but the same ids: ASCII lower case, a final mark apart from its word.

    Left alone are texts with combining marks, with which a capital may compose otherwise than its small
    letter, and those with the start of a special token; and marks after anything but letters and digits.
    """
    odd = pc.match_substring_regex(texts, r"[\x{0280}-\x{02bf}\x{0300}-\x{037f}]|<\|")
    glued = pc.or_(odd, pc.match_substring_regex(texts, r"(?:^|[^\pL\pN])[.,] "))
    low = pc.ascii_lower(texts)
    apart = pc.replace_substring(pc.replace_substring(low, ". ", " . "), ", ", " , ")
    return pc.if_else(odd, texts, pc.if_else(glued, low, apart))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """_id, piece, start, length, ids_crc32: each text's ids and then `end`, cut at capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, last, size = process_wide(f"tokenizer {tokenizer}", lambda: ChunkTokenizer(tokenizer)), np.array([end], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            flat, begin = encoder.encode(b["_t"])
            whole = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
            for doc, x, y in zip(b["_id"].to_pylist(), (4 * begin[:-1]).tolist(), (4 * begin[1:]).tolist(), strict=True):
                n = y - x + 4  # the end's id comes last
                for i in range(-(-n // size)):
                    z = min(x + (i + 1) * size, y + 4)
                    crc = zlib.crc32(whole[x + i * size : min(z, y)])
                    rows.append((doc, i, i * capacity, (z - x) // 4 - i * capacity, zlib.crc32(last, crc) if z > y else crc))
            doc, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return keyed(docs).select("_id", "_t").mapInArrow(run, "_id long, piece int, start long, length long, ids_crc32 long")


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths are in descending order."""
    n = len(lengths)
    sizes = lengths.tolist()
    bins, offsets = [0] * n, [0] * n
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, count = 0, 0

    def put(item: int, into: int, left: int) -> None:
        nonlocal free
        bins[item], offsets[item] = into, capacity - left
        left -= sizes[item]
        if left:
            room[left].append(into)
            free |= 1 << left

    large = sum(3 * s > capacity for s in sizes)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i in range(large - 1, -1, -1):
        waiting[sizes[i]].append(i)
        there |= 1 << sizes[i]
    for i in range(large):
        if waiting[sizes[i]] and waiting[sizes[i]][-1] == i:
            waiting[sizes[i]].pop()
            if not waiting[sizes[i]]:
                there ^= 1 << sizes[i]
        else:  # already the partner of a larger one
            continue
        left = capacity - sizes[i]
        best = (there & ((1 << (left + 1)) - 1)).bit_length() - 1
        if best > 0:
            j = waiting[best].pop()
            if not waiting[best]:
                there ^= 1 << best
            bins[i], offsets[i] = count, 0
            put(j, count, left)
        else:
            put(i, count, capacity)
        count += 1
    for i in range(large, n):
        fits = free >> sizes[i]
        if fits:
            left = sizes[i] + (fits & -fits).bit_length() - 1
            into = room[left].pop()
            if not room[left]:
                free ^= 1 << left
            put(i, into, left)
        else:
            put(i, count, capacity)
            count += 1
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def packed(pieces: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """pieces (any columns with length, _id and piece) with sequence_id and offset.

    The number of groups follows the sum of lengths; rows of the written table are dealt to groups by their
    number in it, so equal ids, or none, don't meet in one group.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(7)), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(t: pa.Table) -> pa.Table:
        length = t["length"].to_numpy()
        order = np.lexsort((t["piece"].to_numpy(), t["_id"].to_numpy(), -length))
        t = t.take(pa.array(order))
        bins, offsets = pack(length[order], capacity)
        base = t["_group"][0].as_py() << 32 if len(order) else 0
        return t.drop_columns("_group").append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(run, schema)


def query(docs: DataFrame, tokenizer: str | None = None, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text).

    Null text counts as empty and gives the end id alone; very long texts are cut, nothing is left out.
    Repeated rows are packed once each. A null doc_id stays null. Of pieces of one length those with the
    smaller doc_id and piece go first. An empty table gives an empty result.
    """
    pieces = written(token_pieces(docs, tokenizer or default_tokenizer(), capacity).repartition(files_for(docs.select("doc_id").count())))
    out = packed(pieces, capacity, group)
    return out.select(doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
