import hashlib
import random
from collections import defaultdict

import pytest

from pagewright.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def fill_slowly(budget, children):
    """Water-filling by rounds: {name: (capacity, weight)} -> {name: share}."""
    out, left = {}, dict(children)
    while left:
        total = sum(w for _, w in left.values())
        level = (budget - sum(out.values())) / total
        full = [k for k, (c, w) in left.items() if c <= level * w]
        if not full:
            return {k: int(level * w // 1) for k, (c, w) in left.items()} | out
        k = min(full, key=lambda k: (left[k][0] / left[k][1], k))
        out[k] = left.pop(k)[0]
    return out


def brute(rows, share, epochs, seed):
    leaves = defaultdict(list)
    for d, t, lang, source in rows:
        source, lang = source or "", lang or ""
        n = int(source[3:]) if source[:3] == "src" and source[3:].isdigit() else None
        domain = "web" if n == 0 else "forum" if n is not None and n <= 6 else "books"
        leaves[domain, lang, source].append((d, len((t or "").split())))
    cap = {k: sum(n for _, n in v) * epochs for k, v in leaves.items()}
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, 1)
    budget = int(sum(cap.values()) // epochs * share)
    domains = fill_slowly(budget, {d: (sum(c for k, c in cap.items() if k[0] == d), weight("domain", d)) for d in {k[0] for k in cap}})
    out = []
    for d, db in domains.items():
        langs = fill_slowly(db, {x: (sum(c for k, c in cap.items() if k[:2] == (d, x)), weight("lang", x)) for x in {k[1] for k in cap if k[0] == d}})
        for x, lb in langs.items():
            for s, allot in fill_slowly(lb, {k[2]: (c, 1) for k, c in cap.items() if k[:2] == (d, x)}).items():
                docs, total = leaves[d, x, s], cap[d, x, s] // epochs
                full = allot // total if total else 0
                out += [(i, d, x, s, e, n) for e in range(full) for i, n in docs]
                rest, at = allot - full * total, 0
                if full < epochs and rest > 0:
                    for _, _, i, n in sorted((hashlib.md5(":".join([str(seed), str(full)] + ([] if i is None else [str(i)])).encode()).hexdigest()[:15], i is not None, i if i is not None else 0, n) for i, n in docs):
                        i = next(j for j, m in docs if (j if j is not None else 0) == i and m == n)
                        at += n
                        if at > rest:
                            break
                        out.append((i, d, x, s, full, n))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["en"] * 6 + ["de", "fr", "es"]), r.choice(["src0"] * 5 + [f"src{i}" for i in range(10)])) for i in range(600)]
    return rows + [(900, None, "en", "src1"), (901, "a b", None, None), (None, "c d e", "xx", "else"), (902, " \t ", "de", "src0")]


@pytest.mark.parametrize(("share", "epochs", "bucket"), [(0.8, 2, 512), (0.5, 1, 8), (1.7, 3, 1), (9.0, 2, 20)])
def test_equals_brute_force(spark, share, epochs, bucket):
    rows = corpus(int(share * 10))
    got = mixing.query(spark.createDataFrame(rows, SCHEMA), share=share, epochs=epochs, bucket=bucket, broadcast=[0, 20_000][bucket > 1]).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, share, epochs, 11)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100, 1), ("web", "en", "b", 1000, 1), ("forum", "en", "c", 1000, 1)], "domain string, lang string, source string, tokens long, docs long")
    got = {r.source: r.allot for r in mixing.budgets(leaves, 0.5, 1, {"domain": {"web": 1, "forum": 1}, "lang": {}, "source": {}}).collect()}
    assert got == {"a": 100, "b": 425, "c": 525}


def test_taken_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(*r, "x") for r in corpus(1)], SCHEMA + ", epoch string")
    got = mixing.taken(docs, share=0.5)
    assert got.columns == docs.columns and 0 < got.count() < docs.count()
    assert mixing.query(docs.limit(0)).collect() == []


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_repeated_rows_are_taken_one_by_one(spark, broadcast):
    rows = [(7, "w " * 10, "en", "src1")] * 40 + [(None, "n " * 10, "en", "src1")] * 40 + [(i, "w " * 10, "en", "src1") for i in range(100, 120)]
    rows += [(7, "other text", "en", "src1"), (None, "v " * 50, "de", "src2"), (9, "", "de", "src2"), (9, None, "de", "src2")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", _row long").repartition(5)
    options = {"share": 0.6, "weights": {x: {} for x in mixing.LEVELS}, "broadcast": broadcast}
    picked = mixing.query(docs, epochs=1, **options).collect()
    taken = mixing.taken(docs, **options).collect()
    key = lambda d, n: (str(d), n)
    assert sorted(key(r.doc_id, r.n_tokens) for r in picked) == sorted(key(r.doc_id, len((r.text or "").split())) for r in taken)
    assert len({r._row for r in taken}) == len(taken) and {tuple(r) for r in taken} <= {(*r, i) for i, r in enumerate(rows)}
    short = [r for r in taken if r.source == "src1"]
    assert 0 < len(short) < 101 and sum(len(r.text.split()) for r in short) <= 1002


def test_long_text(spark):
    rows = [(1, "v " * 200_000, "de", "src2"), (2, "w " * 5, "de", "src2"), (None, None, None, None)]
    got = mixing.query(spark.createDataFrame(rows, SCHEMA), share=1.0, epochs=1).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 200_000), ("2", 5)]
