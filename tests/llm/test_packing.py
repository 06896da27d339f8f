import random
import zlib

import numpy as np
import pytest

from pagewright.llm import packing

SCHEMA = "doc_id long, text string"


def rows():
    r = random.Random(4)
    words = ["The", "naïve", "cat's", "42", "don't", "Straße", "ΣΑΣ", "<|endoftext|>", "x<|endoftext|>y", "éte", " ", "a\x1cb", "???!", "日本語", "İ"]
    out = [(i, " ".join(r.choices(words, k=r.choice([1, 5, 80, 700])))) for i in range(60)]
    return out + [(60, None), (61, ""), (62, " \n\t"), (None, "null id"), (63, "w " * 9000), (63, "w " * 9000)]


def test_pieces_are_the_tokenizers_and_sequences_are_gapless(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for d, text in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), 4096):
            p = ids[i : i + 4096]
            want.append((d, i // 4096, i, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    got = packing.query(spark.createDataFrame(rows(), SCHEMA), group=20_000).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.query(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_few_bins(seed):
    r = np.random.default_rng(seed)
    sizes = np.sort(np.r_[r.integers(1, 4097, 400), r.integers(1, 300, 2000 * (seed % 2))])[::-1]
    bins, offsets = packing.pack(sizes, 4096)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 4096 and len(fill) == bins.max() + 1 and fill.min() > 0
    assert all(np.count_nonzero(3 * sizes[bins == b] > 4096) <= 2 for b in range(len(fill)))
    assert len(fill) <= (np.ceil(sizes.sum() / 4096) * 1.01 + 1 if seed % 2 else max(np.ceil(sizes.sum() / 4096) * 1.12, np.count_nonzero(2 * sizes > 4096) + 20))


def test_rows_without_ids_are_dealt_to_all_groups(spark):
    docs = spark.createDataFrame([(None, "w " * 499, 1) for _ in range(400)], SCHEMA + ", piece int")
    got = packing.query(docs, group=20_000).collect()
    tokens = {}
    for r in got:
        tokens[r.sequence_id >> 32] = tokens.get(r.sequence_id >> 32, 0) + r.length
    assert sum(tokens.values()) == 200_000 and max(tokens.values()) <= 40_000
    assert len({r.sequence_id for r in got}) <= 50 + len(tokens)


def test_another_tokenizer_file_encodes_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, some = Tokenizer.from_file(path), [(i, x) for i, (_, x) in enumerate(rows()[:20])]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.query(spark.createDataFrame(some, SCHEMA), tokenizer=path, capacity=10**6).collect()}
    for i, text in some:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_odd_chunks_with_a_small_memory():
    import pyarrow as pa
    from tokenizers import Tokenizer

    e, t = packing.ChunkTokenizer(packing.default_tokenizer(), remembered=2), Tokenizer.from_file(packing.default_tokenizer())
    texts = ["A. b, c., d .. e!, 5. x", ", . lead", "don't. I'll, o'", "<|EndOfText|> <|endoftext|>", "E\u0301. e\u0301, \u0130. \u03a3.", "a\u0300. b", "w%%% w&&&. ### \u00e9%. \u65e5\u672c.", "", " \n", "tail."]
    for _ in range(3):
        ids, at = e.encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == t.encode(text, add_special_tokens=False).ids
