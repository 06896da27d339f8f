import hashlib
import random

import pytest

from pagewright.llm import rlz

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    low = -(2**63)
    # a row without a doc_id is a document of its own
    keys = [(low if d is None else d, i if d is None else -1, t or "") for i, (d, t) in enumerate(rows)]
    first, words = {}, {}
    for key in sorted({*keys}):
        w = words[key] = key[2].encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (key, i))
    out = []
    for key, (d, _) in zip(keys, rows, strict=True):
        w, gone = words[key], set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (key, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=60, vocabulary=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["é", "Z"]
    passages = [" ".join(r.choices(words, k=r.randint(4, 60))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choices(words, k=r.randint(1, 40))) for _ in range(r.randint(1, 6))]
        docs.append((i * 7 % n, r.choice([" ", "\n", "\t "]).join(parts)))
    return docs + [(n, "a " * 70), (n + 1, "a " * 30), (n + 2, None), (n + 3, ""), (n + 4, docs[0][1]), (n + 4, docs[0][1]), (None, docs[1][1]), (n + 5, " ")]


@pytest.mark.parametrize(("window", "gram", "flush", "hot"), [(20, 6, 2_000_000, 64), (5, 2, 50, 3), (20, 6, 40, 1), (3, 3, 10, 5), (8, 4, 9999, 2)])
def test_equals_brute_force(spark, window, gram, flush, hot):
    rows = texts(window + flush)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rlz.query(docs, window, gram=gram, flush=flush, hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_factors_hold_their_source(spark):
    from pagewright.llm._shared import keyed

    rows = [(i, t) for i, (_, t) in enumerate(texts(9)) if t]
    words = {i: t.split() for i, t in rows}
    found = rlz.factors(keyed(spark.createDataFrame(rows, SCHEMA)), 8, gram=3).collect()
    assert found
    for f in found:
        assert f.e - f.s >= 8 and (f.src, f.src_s) < (f._id, f.s)
        assert words[f._id][f.s : f.e] == words[f.src][f.src_s : f.src_s + f.e - f.s]


def test_cut_text_and_empty_table(spark):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, p, "x", 1), (2, f"so\n{p}\nthen", "y", 1), (3, p, None, 1), (4, None, None, None), (5, "short", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, n_chars long")
    got = {r.doc_id: (r.text, r._id, r.n_chars) for r in rlz.without_repeats(docs).collect()}
    assert got == {1: (p, "x", 1), 2: ("so\nthen", "y", 7), 4: (None, None, None), 5: ("short", None, None)}
    assert rlz.without_repeats(docs.limit(0)).collect() == [] == rlz.query(docs.limit(0)).collect()


def test_rows_without_ids_and_ids_of_many_texts(spark):
    p = " ".join(f"p{i}" for i in range(30))
    # the first two texts have one 32-bit hash
    rows = [(None, "doc number 203737 text"), (None, "doc number 307438 text"), (1, "doc number 203737 text"), (2, "doc number 307438 text")]
    rows += [(None, p)] * 5 + [(3, p)] + [(4, f"{p} {i}") for i in range(6)] + [(5, f"{p} end")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(map(tuple, rlz.query(docs, 3, gram=2).collect()), key=str)
    n = lambda d: sorted(r[2] for r in got if r[0] == d)
    assert n(None) == [0, 0, 30, 30, 30, 30] or n(None) == [0, 0, 0, 30, 30, 30, 30]
    assert n(1) == n(2) == [4] and n(3) == [30] and n(5) == [30] * 3 and sum(x >= 30 for x in n(4)) == 6
    kept = rlz.without_repeats(docs, 3, gram=2).collect()
    assert sum(r.text == p for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 3


def test_long_texts(spark):
    r = random.Random(2)
    long = " ".join(f"w{r.randrange(50)}" for _ in range(60_000))
    rows = [(1, long), (2, "x " + long[:300_000] + " y"), (3, "short")]
    got = rlz.query(spark.createDataFrame(rows, SCHEMA), 20, flush=20_000).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 20)


def test_greedy_factors():
    import numpy as np

    # two stretches: a b c d e and x b c d y b c; the second's first places: b c d again at 1, b c once more
    first = np.array([0, 1, 2, 3, 4, 5, 1, 2, 3, 9, 1, 2])
    stretch = np.array([0] * 5 + [1] * 7)
    at, size = rlz.parsed(first, first != np.arange(12), stretch)
    assert (at.tolist(), size.tolist()) == ([6, 10], [3, 2])
    # a factor ends where its source does; the phrase that straddles its end is looked up next
    first = np.array([0, 1, 2, 3, 0, 1, 2, 3])
    stretch = np.array([0, 0, 1, 1, 2, 2, 2, 2])
    at, size = rlz.parsed(first, first != np.arange(8), stretch)
    assert (at.tolist(), size.tolist()) == ([4, 6], [2, 2])
