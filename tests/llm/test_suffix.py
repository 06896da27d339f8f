import hashlib
import random
from collections import defaultdict

import pytest

from pagewright.llm import suffix

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    places = defaultdict(set)
    for n, (d, t) in enumerate(rows):  # a row without a doc_id is a document of its own
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            places[b[i : i + length]].add((d, b, i, n if d is None else -1))
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - length + 1):
            if len(places[b[i : i + length]]) > 1:
                gone |= set(range(i, i + length))
        kept = bytes(x for i, x in enumerate(b) if i not in gone)
        spans = sum(i in gone and i - 1 not in gone for i in range(len(b)))
        out.append((d, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=50):
    r = random.Random(seed)
    chars = "abcdeé \n"
    passages = ["".join(r.choices(chars, k=r.randint(20, 400))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(r.choices(chars, k=r.randint(1, 300))) for _ in range(r.randint(1, 5))]
        docs.append((i, "".join(parts)))
    return docs + [(n, "a" * 700), (n + 1, "ab" * 90), (n + 2, None), (n + 3, ""), (n + 4, docs[0][1]), (n + 4, docs[0][1]), (None, docs[1][1]), (n + 5, "x" * 199), (n + 6, "é" * 150)]


@pytest.mark.parametrize(("length", "q", "hot", "flush"), [(200, 64, 2000, 2_000_000), (40, 8, 3, 500), (64, 16, 1, 10_000), (50, 50, 2, 100)])
def test_equals_brute_force(spark, length, q, hot, flush):
    rows = texts(length + q)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = suffix.query(docs, length, q=q, hot=hot, flush=flush, least=50).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 333)
    rows = texts(5, 12)
    got = suffix.query(spark.createDataFrame(rows, SCHEMA), 60, q=16).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 60)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "q" * 500, 3), (2, "short", 4)], "doc_id long, text string, _id long")
    assert {tuple(r)[:4] for r in suffix.query(docs).collect()} == {(1, 500, 500, 1), (2, 5, 0, 0)}
    assert suffix.query(docs.limit(0)).collect() == []


def test_rows_without_ids_and_ids_of_many_texts(spark):
    r = random.Random(3)
    p = "".join(r.choices("abcdefgh", k=90))
    rows = [(None, p), (None, p + "!"), (None, p), (1, "x" + p), (1, "y" + p), (2, "z" * 30), (None, "".join(r.choices("ijkl", k=90)))]
    got = suffix.query(spark.createDataFrame(rows, SCHEMA).repartition(3), 60, q=16).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 60)


def test_bucket_numbers():
    import numpy as np

    text = b"abcdefgh-abcdefgx-abcdefgh"
    data = np.frombuffer(text, np.uint8)
    left = len(text) - np.arange(len(text))
    grams = suffix.gram_buckets()(data, 2)
    for length in (2, 3, 4, 7, 8):
        bucket = suffix.refined(grams, left, 2, length)
        for i in range(len(text)):
            s = text[i : i + length]
            same = [j for j in range(len(text) - length + 1) if text[j : j + length] == s]
            assert (bucket[i] >= 0) == (len(s) == length and len(same) > 1)
            assert len({bucket[j] for j in same}) <= 1
