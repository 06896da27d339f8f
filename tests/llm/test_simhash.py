import random

import numpy as np
import pytest
import xxhash

from pagewright.llm import minhash, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    fps = {}
    for d, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {d: d for d in fps}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (f"{fps[d]:016x}", root(d)) for d in ids}


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=300)) for _ in range(8)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 1, 1, 2, 6])):
            w[r.randrange(len(w))] = "changed"
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "  \t"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "É é x y")]


@pytest.mark.parametrize("bucket", [8192, 3])
def test_components_equal_brute_force(spark, bucket):
    rows = texts()
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    out = simhash.near_components(docs, bucket=bucket).collect()
    got = {r._id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out}
    assert got == brute(rows)


def test_every_pair_within_radius_meets_in_a_table():
    r = np.random.default_rng(3)
    for turn in range(4):
        masks = cover = simhash.cover(3, turn)
        assert len(cover) == 15
        for _ in range(2000):
            diff = sum(1 << int(i) for i in r.choice(64, 3, replace=False))
            assert any(not m & diff for m in masks)


def test_a_refined_bucket_is_bounded():
    masks = [simhash.cover(3, turn) for turn in range(simhash.LEVELS)]
    free = max((2**64 - 1 & ~(a | b | c)).bit_count() for a in masks[0] for b in masks[1] for c in masks[2])
    assert simhash.LEVELS == 3 and 2**free <= simhash.BUCKET


def test_edge_cases(spark):
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None)]
    docs = spark.createDataFrame([(d, t, "x", None, 1, 7) for d, t in rows], SCHEMA + ", _id long")
    out = {tuple(r) for r in simhash.query(docs).collect()}
    assert {r[0] for r in out} == {None, 5} and {r[2] for r in out} == {None}
    assert simhash.query(docs.limit(0)).collect() == []
    assert sorted(str((r.doc_id, r.text)) for r in simhash.keep_one(docs).collect()) == ["(None, 'a b c')", "(None, None)"]
    assert simhash.keep_one(docs).columns == docs.columns


def near_texts(seed=4, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=k)) for k in (30, 120, 500)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randrange(max(2, len(w) // 15))):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append((i, " ".join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "One two"), (n + 3, "one TWO"), (n + 4, out[0][1].upper()), (None, out[1][1]), (n + 5, "alone " * 9)]


def kept_by_brute_force(rows):
    sets = [set(simhash.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    part = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]) and part[i] != part[j]:
                part = [part[j] if p == part[i] else p for p in part]
    best = {}
    for (d, _), p in zip(rows, part, strict=True):
        best[p] = min(best.get(p, 10**9), -1 if d is None else d)
    return sorted(best.values())


@pytest.mark.parametrize("most, part", [(64, 2048), (2, 2048), (2, 4), (64, 1)])
def test_keep_one_equals_brute_force(spark, most, part):
    rows = near_texts()
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA).repartition(3)
    got = simhash.keep_one(docs, most=most, rows=part).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == kept_by_brute_force(rows)
    text = dict(rows)
    assert all(r.text == text[r.doc_id] for r in got)


def test_keep_one_keeps_one_row_of_an_id(spark):
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_keep_one_keeps_a_row_of_each_group_whatever_its_id(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, text(i)) for i in range(6)] + [(4, text(i)) for i in range(10, 14)] + [(i, text(0)) for i in (7, 9)]
    rows += [(4, text(20)), (5, text(20)), (8, text(20) + " more"), (4, text(10)), (None, text(1))]
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert got == sorted([("None", text(i)) for i in range(6)] + [("4", text(i)) for i in (10, 11, 12, 13, 20)])


def test_near_copies_of_one_print_behind_a_failed_link(spark, monkeypatch):
    # a repeated run sets the print and counts once in a set; without bands only prints give candidates
    monkeypatch.setattr(minhash, "band_links", lambda rows, *_: rows.select(rows["c"].alias("a"), rows["c"].alias("b")).limit(0))
    rows = [(i, "over " * 2000 + " ".join(f"w{i // 2}x{j}" for j in range(60)) + " end" * (i % 2)) for i in range(24)]
    assert len({simhash.majority(simhash.shingle_hashes(t, 5)) for _, t in rows}) == 1
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == list(range(0, 24, 2))


def test_a_large_family_is_one_group(spark):
    # most pairs lie below the threshold, a few texts with fewer changes link all others
    r = random.Random(7)
    base = [f"b{i}" for i in range(2000)]
    rows, sets = [], []
    for i in range(300):
        w, changed = list(base), r.sample(range(2000), 16 if i % 50 == 3 else 26)
        for j in changed:
            w[j] = f"x{i}y{j}"
        rows.append((i, " ".join(w)))
        sets.append(np.convolve(np.isin(np.arange(2000), changed), np.ones(5), "valid") < 0.5)
    m = np.array(sets, np.float32)
    both = m @ m.T
    linked = both >= 0.8 * (2 * 1996 - both)
    seen, todo = {0}, [0]
    while todo:
        for j in np.flatnonzero(linked[todo.pop()]).tolist():
            if j not in seen:
                seen.add(j)
                todo.append(j)
    assert len(seen) == 300 and linked.mean() < 0.2
    docs = spark.createDataFrame([(d, t, None, None, 1) for d, t in rows], SCHEMA).repartition(4)
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]
    assert [r.doc_id for r in simhash.keep_one(docs, most=8, rows=100).collect()] == [0]


def test_long_and_repeated_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (4, "")]
    docs = spark.createDataFrame([(d, t, None, None, 1, "x", i) for i, (d, t) in enumerate(rows)], SCHEMA + ", _h string, c long").repartition(3)
    got = simhash.keep_one(docs, shingles=1000)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]
    by = {}
    for r in simhash.query(docs).collect():
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert len(by[3]) == 1 and by[None] == by[4]
