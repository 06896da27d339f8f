import math
import random
import zlib

from pagewright.llm import langid

SCHEMA = "doc_id long, text string, lang string"
PARTS = {"aa": ["the", "ing", "tion", "er"], "bb": ["sch", "ung", "heit", "und"], "cc": ["eau", "oux", "ç", "é"]}


def corpus(n=400):
    r = random.Random(3)
    rows = []
    for i in range(n):
        lang = r.choice(list(PARTS))
        rows.append((i, " ".join("".join(r.choices(PARTS[lang], k=r.randint(1, 4))) for _ in range(r.randint(1, 40))), lang))
    return rows


def test_held_out_accuracy_and_split(spark):
    rows = corpus()
    out = langid.query(spark.createDataFrame(rows, SCHEMA), rows=60).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [(r.lang_pred, rows[r.doc_id][2]) for r in out if r.held_out]
    assert len(held) > 40 and sum(a == b for a, b in held) / len(held) > 0.97


def test_backs_off_to_shorter_grams():
    m = langid.Model([(0, "haus", "de", 5), (0, "house", "en", 5), (3, "sch", "de", 9), (3, "sch", "en", 1), (1, "w", "en", 5), (1, "w", "de", 1), (5, "tions", "en", 4), (5, "ungen", "de", 4), (1, "x", "de", 20)])
    pick = lambda w: m.languages[int(m.scores([w])[0].argmax())]
    assert [pick("haus"), pick("house"), pick("schule"), pick("w"), pick("nations")] == ["de", "en", "de", "en", "en"]
    assert not m.scores(["???"]).any()


def test_edge_cases(spark):
    rows = [*corpus(100), (500, None, "aa"), (501, "", None), (502, "12 .,_", "bb"), (None, "undundund", "bb"), (503, "über " * 5, None), (503, "über " * 5, None)]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], SCHEMA + ", score double")
    by = {}
    for r in langid.query(docs).collect():
        by.setdefault(r.doc_id, []).append((r.held_out, r.lang_pred, r.score))
    assert [by[i][0][1:] for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[None][0][:2] == (False, "bb") and len(by[503]) == 2 and by[503][0] == by[503][1]
    assert langid.query(docs.limit(0)).collect() == []
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.query(unlabelled).collect()} == {"und"}
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert not kept & {500, 501, 502} and {None, 503} <= kept


def test_words_beyond_what_is_remembered():
    import pyarrow as pa

    m = langid.Model([(0, "haus", "de", 5), (0, "house", "en", 5), (1, "h", "de", 1), (1, "h", "en", 1)])
    small, texts = langid.Scorer(m, remembered=1), ["haus haus x", "house a b c d e f", " haus " * 10, "", None, "7"]
    for _ in range(2):
        for part in (texts[:2], texts[2:4], texts[4:]):
            (a, x), (b, y) = small.predict(pa.array(part, pa.string())), langid.Scorer(m).predict(pa.array(part, pa.string()))
            assert a.equals(b) and x.tolist() == y.tolist()


def slow(rows):
    """lang_pred and score of each row, word by word and gram by gram."""
    counts, total, size = {}, {}, {}
    for d, text, lang in rows:
        if d is None or text is None or lang is None or zlib.crc32(str(d).encode()) % 5 == 0:
            continue
        for w in langid.LETTERS.findall(text.lower()):
            e = f"^{w}$"
            for key in [(0, w)] + [(n, e[i : i + n]) for n in range(1, 6) for i in range(len(e) - n + 1)]:
                by = counts.setdefault(key, {})
                by[lang] = by.get(lang, 0) + 1
                total[key[0], lang] = total.get((key[0], lang), 0) + 1
    for kind, _ in counts:
        size[kind] = size.get(kind, 0) + 1
    languages = sorted({x for by in counts.values() for x in by})
    log = lambda key, x: math.log((counts[key].get(x, 0) + 0.5) / (total.get((key[0], x), 0) + 0.5 * size[key[0]]))
    out = []
    for _, text, _ in rows:
        words, sums = langid.LETTERS.findall((text or "").lower()), dict.fromkeys(languages, 0.0)
        for w in words:
            keys, e = [(0, w)] if (0, w) in counts else [], f"^{w}$"
            for n in range(5, 0, -1):
                keys = keys or [(n, e[i : i + n]) for i in range(len(e) - n + 1) if (n, e[i : i + n]) in counts]
            for x in languages if keys else []:
                sums[x] += sum(log(k, x) for k in keys) / len(keys)
        if not words:
            out.append(("und", 0.0))
            continue
        p = {x: math.exp(v / len(words) * min(len(words), 20)) for x, v in sums.items()}
        best = max(languages, key=lambda x: p[x])
        out.append((best, p[best] / sum(p.values())))
    return out


def test_equals_brute_force(spark):
    rows = [*corpus(120), (300, None, "aa"), (301, "9 .", "bb"), (302, "XUNDER theOUX", None), (None, "ing schßß", "cc"), (303, "the " * 3000, "aa")]
    got = langid.query(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = sorted(zip((str(r[0]) for r in rows), slow(rows), strict=True))
    for (d, (lang, score)), r in zip(want, sorted(got, key=lambda r: str(r.doc_id)), strict=True):
        assert (d, lang) == (str(r.doc_id), r.lang_pred) and abs(score - r.score) < 1e-4


def test_each_language_keeps_its_features(spark):
    rows = [(i, " ".join("".join(x) for x in zip("abcdefgh", "ijklmnop" * 2)) * 9, "aa") for i in range(200)] + [(1000 + i, "qxyz wvut", "zz") for i in range(12)]
    m = langid.learn(spark.createDataFrame(rows, SCHEMA), features=30)
    assert "qxyz" in m.known[0] and m.languages == ["aa", "zz"] and sum(map(len, m.known)) <= 60
