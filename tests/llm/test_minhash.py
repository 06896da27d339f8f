import hashlib
import random

import numpy as np
import pytest
import xxhash

from pagewright.llm import minhash

SCHEMA = "doc_id long, text string"


def texts(n=90):
    r = random.Random(2)
    words = [f"wörd{i}" for i in range(300)]
    return [(i * 5, " ".join(r.choices(words, k=r.choice([0, 1, 3, 40, 400])))) for i in range(n)] + [(7, None), (None, "null id é"), (10, "again"), (10, "again")] + [(None, f"none {i // 2} or so") for i in range(30)] + [(15, f"one id {i}") for i in range(20)]


MASK = 2**64 - 1


def slow_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def slow_signature(text):
    """128 permutations of the runs of five words, blank words at both ends, in plain integers."""
    words = [xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    if not words:
        return [0xFFFF] * 128
    words, runs = [0] * 4 + words + [0] * 4, set()
    for i in range(len(words) - 4):
        h = 0
        for x in words[i : i + 5]:
            h = (h * 0x9E3779B97F4A7C15 + x) & MASK
        runs.add(slow_mix(h))
    seeds = [slow_mix(i * 0x9E3779B97F4A7C15 & MASK) for i in range(1, 257)]
    return [slow_mix(min((h * (a | 1) + b) & MASK for h in runs)) >> 48 for a, b in zip(seeds[:128], seeds[128:], strict=True)]


@pytest.mark.parametrize("range_rows", [4000, 10, 1])
def test_edited_texts_and_likeness(spark, range_rows):
    rows = texts()
    low = -(2**63)
    # equal ids follow each other by falling hash of the text; repeated rows are one document
    name = lambda t: (x := 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)) - (2**64 if x >= 2**63 else 0)
    every = [(low if d is None else d, name(t), t or "") for d, t in rows]
    order, want = sorted({*every}, reverse=True), []
    for (d, h, t), (_, _, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        m = len(t) // 3
        new = t[: len(t) - m] + nxt[:m]
        s, e, f = map(slow_signature, (t, new, nxt))
        alike = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) / 128
        want += every.count((d, h, t)) * [(None if d == low else d, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{x:04x}" for x in s), "".join(f"{x:04x}" for x in e), alike(s, e), alike(s, f))]
    got = minhash.query(spark.createDataFrame(rows, SCHEMA).repartition(3), range_rows=range_rows).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    docs = spark.createDataFrame([(2, long, 5, "x"), (1, "short", 6, None)], SCHEMA + ", _id long, fingerprint string")
    got = {r.doc_id: r for r in minhash.query(docs).collect()}
    assert got[2].n_chars == len(long) and got[2].near_next == 0.0 and got[1].near_next == 0.0
    assert got[1].edited_sha256 == hashlib.sha256(b"shor" + long[:1].encode()).hexdigest()


def test_groups_of_rows_without_ids_and_ids_of_many_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, a), (None, b), (4, b + " more"), (4, a + " more"), (4, "a b c d e f"), (9, a), (9, a)]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", c long").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, None, None), (None, None, None), (4, 4, None), (4, 4, None), (4, 4, 4), (9, None, None), (9, None, None)]))


def test_small_tables(spark):
    one = spark.createDataFrame([(3, "a b c d e f")], SCHEMA)
    r = minhash.query(one).first()
    assert (r.doc_id, r.n_chars, r.near_next) == (3, 11, 1.0)
    assert minhash.query(one.limit(0)).collect() == [] == minhash.near_duplicates(one.limit(0)).collect()


def test_signature_estimates_jaccard():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(2000 * share)
        a, b = x[:2000], np.r_[x[:n], x[2000 : 4000 - n]][:2000]
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - j) < 0.15


@pytest.mark.parametrize("most", [64, 2])
def test_near_duplicates(spark, most):
    r = random.Random(5)
    base = [[f"b{k}w{i}" for i in range(200)] for k in range(4)]
    rows = []
    for i in range(40):
        w = list(base[i % 4])
        for _ in range(r.choice([0, 1, 2])):
            w[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows + [(90, None), (91, "")], SCHEMA), most=most).collect()
    assert {r.doc_id: r.group_id for r in got} == {**{i: i % 4 for i in range(40)}, 90: 90, 91: 90}


def template_family(n=1500, pairs=60, fixed=204, own=29, shared=9):
    """Texts of Jaccard 0.775 by their common template; text 2i + 1 of the first pairs has 0.81 with 2i."""
    head = " ".join(f"t{i}" for i in range(fixed))
    rows = []
    for i in range(n):
        tail = [f"u{i}x{j}" for j in range(own)]
        if i < 2 * pairs and i % 2:
            tail[-shared:] = [f"u{i - 1}x{j}" for j in range(own)][-shared:]
        rows.append((i, f"{head} {' '.join(tail)}"))
    return rows, {i: i - 1 if i < 2 * pairs and i % 2 else i for i in range(n)}


def test_pairs_at_the_threshold_in_a_template_family(spark):
    from pagewright.llm import simhash

    rows, group = template_family()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(group.values()))
